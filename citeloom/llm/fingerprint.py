"""Document fingerprints of closed syncmers (operator 4).

A k-mer of code points is a closed syncmer if its least s-mer stands at its
first or last place. That depends on the k-mer alone, so an edit moves or
drops only the anchors it touches and shared passages keep theirs wherever
they stand. A fingerprint is the list of the least distinct anchor hashes, KEEP
of them and one more for each PER_ANCHOR characters of the text, each with the
place where it first stands, in hexadecimal.

The likeness of two fingerprints is positional: anchors of one hash are
matched, and of the matches only the longest chain counts that goes forward in
both texts. Its share of the union of the anchors (up to the hash where both
lists are whole) is the likeness: an estimate of the share of the two texts
that stands in both, in one order.

Defined cases: a text shorter than a k-mer, or one without a syncmer, has the
hash of the whole text as its one anchor; the empty text (and null) has the
fingerprint "" and likeness 1 to itself, 0 to any other.
"""

from __future__ import annotations

import gc
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.llm.common import rows_of, text_of
from citeloom.llm.hashing import least, mixed, runs

K, S, KEEP, PER_ANCHOR = 12, 5, 64, 256
#: What an entry of a fingerprint is made of, in its byte order.
ENTRY = np.dtype([("hash", ">u8"), ("place", ">u4")])


def positions(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places (code points) of the closed syncmers, in text order."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if len(codes) < k:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    inner = mixed(runs(codes, s))
    span, m = k - s + 1, len(codes) - k + 1
    low = least(inner, span)
    at = np.nonzero((inner[:m] == low) | (inner[span - 1 : span - 1 + m] == low))[0]
    return mixed(runs(codes, k)[at]), at


class Sketch:
    """The least distinct anchors of a text, by hash, each with its first place; whole if these are all."""

    def __init__(self, text: str, k: int = K, s: int = S, keep: int = KEEP):
        keep += len(text) // PER_ANCHOR
        anchors, at = positions(text, k, s) if text else (np.empty(0, np.uint64), np.empty(0, np.int64))
        if text and not len(anchors):
            anchors, at = np.array([xxhash.xxh64_intdigest(text.encode())], np.uint64), np.zeros(1, np.int64)
        if len(anchors) > 8 * keep:  # the least few hold the sketch unless they repeat too often
            few = np.sort(np.argpartition(anchors, 4 * keep)[: 4 * keep])
            if len(np.unique(anchors[few])) > keep:
                # Places of the greatest may be missing, but those stay out.
                anchors, at = anchors[few], at[few]
        values, first = np.unique(anchors, return_index=True)
        self.whole = len(values) <= keep
        self.hashes, self.places = values[:keep], at[first[:keep]]

    def show(self) -> str:
        out = np.empty(len(self.hashes), ENTRY)
        out["hash"], out["place"] = self.hashes, self.places
        return out.tobytes().hex()


def longest_chain(places: list[int]) -> int:
    """Length of the longest strictly rising subsequence."""
    ends: list[int] = []
    for p in places:
        k = bisect_left(ends, p)
        ends[k : k + 1] = [p]
    return len(ends)


def likeness(a: Sketch, b: Sketch) -> float:
    """Share of the union of the two texts' anchors that stands in both in one order."""
    x, y = a.hashes, b.hashes
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    # Compare up to the hash where both lists are whole.
    limits = [v[-1] for v, whole in ((x, a.whole), (y, b.whole)) if not whole]
    if limits:
        x, y = (v[: np.searchsorted(v, min(limits), "right")] for v in (x, y))
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    order = np.argsort(a.places[i], kind="stable")
    return longest_chain(b.places[j][order].tolist()) / (len(x) + len(y) - len(i))


def edited(text: str, following: str) -> str:
    """text with its last third replaced by the beginning of another."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


#: Ranges of ids at most: what comes to the driver is three numbers for each, whatever the number of rows.
MOST_PARTS = 1 << 14


def by_descending_id(docs: DataFrame, id_col: str, text_col: str, rows_per_part: int, most_parts: int = MOST_PARTS) -> tuple[DataFrame, list[int | None], list[int]]:
    """Rows (id, text, part), the largest id of each part, and the parts that have rows.

    Rows go by descending id, nulls last, then text. Ids are cut into ranges by
    quantiles, part 0 having the largest. One number for each range comes to
    the driver, and a row finds its range by binary search.
    """
    rows = docs.select(docs[id_col].alias("id"), text_of(docs[text_col]).alias("text"))
    # A range streams through its task, so it may be as long as it likes.
    parts = max(1, min(most_parts, -(-docs.count() // rows_per_part)))
    shares = [i / parts for i in range(1, parts)]
    cuts = sorted(set(docs.select(F.percentile_approx(id_col, shares, min(100 * parts, 200_000) + 1000)).first()[0] or []), reverse=True) if shares else []
    part = F.lit(0)
    if cuts:
        # How many cuts lie above the id: each cut is the least id of its part.
        known, steps = F.lit(cuts), F.lit([1 << k for k in reversed(range(len(cuts).bit_length()))])
        above = lambda k: F.coalesce(F.try_element_at(known, k) > F.col("id"), F.lit(False))
        part = F.aggregate(steps, F.lit(0), lambda found, step: F.when(above(found + step), found + step).otherwise(found))
        part = F.when(F.col("id").isNull(), F.lit(len(cuts))).otherwise(part)
    rows = rows.withColumn("part", part)
    heads = {r["part"]: r["id"] for r in rows.groupBy("part").agg(F.max("id").alias("id")).collect()}
    return rows, [heads.get(p) for p in range(len(cuts) + 1)], sorted(heads)


def compare_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_part: int = 4000, most_parts: int = MOST_PARTS) -> DataFrame:
    """Fingerprint every text, its edited text, and compare both with the next.

    The next row is the one with the next smaller id (ties by text; nulls
    last); after the last comes the first. Each range of ids holds its own rows
    and, borrowed, the first row of the next range, so that one pass over
    sorted partitions finds all successors and texts are shuffled once. Returns
    (id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next).
    """
    rows, heads, used = by_descending_id(docs, id_col, text_col, rows_per_part, most_parts)
    own = rows.select("part", F.lit(False).alias("borrowed"), "id", "text")
    if used:
        # The first row of a part, of several with its id the least text, goes to the part before as well.
        lender: list[int | None] = [None] * len(heads)
        for at, part in enumerate(used):
            lender[part] = used[at - 1]
        head = F.element_at(F.lit(heads) if any(h is not None for h in heads) else F.array(*[F.lit(None).cast("long")] * len(heads)), F.col("part") + 1)
        first = rows.filter(F.col("id").eqNullSafe(head)).groupBy("part", "id").agg(F.min("text").alias("text"))
        own = own.unionByName(first.select(F.element_at(F.lit([-1 if p is None else p for p in lender]), F.col("part") + 1).alias("part"), F.lit(True).alias("borrowed"), "id", "text"))
    dealt = own.repartitionById(len(heads), "part").sortWithinPartitions("part", "borrowed", F.col("id").desc_nulls_last(), "text")
    schema = T.StructType([
        T.StructField("id", rows.schema["id"].dataType), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()),
    ])

    def pair(text: str, own: Sketch, following: str, theirs: Sketch) -> tuple:
        changed = edited(text, following)
        other = Sketch(changed)
        return len(text), hashlib.sha256(changed.encode()).hexdigest(), own.show(), other.show(), likeness(own, other), likeness(own, theirs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        held = None  # the last row that waits for its successor
        out: list[tuple] = []
        for part, borrowed, doc, text in rows_of(batches, ("part", "borrowed", "id", "text")):
            if held is not None and held[0] == part:
                now = Sketch(text)
                out.append((held[1], *pair(held[2], held[3], text, now)))
                held = None if borrowed else (part, doc, text, now)
            elif not borrowed:
                held = (part, doc, text, Sketch(text))
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema.names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema.names)

    arrow = pa.schema([("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    return dealt.mapInArrow(run, schema).withColumnRenamed("id", id_col)
