"""Repeated passages across documents, and inside them (operator 3).

Paragraph MinHash banding with exact verification. Lines and documents play no
part: paragraphs are cut by what they say, so a passage is cut alike wherever
it stands.

1. An anchor is the least of RUN consecutive GRAM-word shingles (the MinHash of
   that stretch); any 24 words have one. Around an anchor stand three
   paragraphs of PARAGRAPH words, which begin 0, 6 and 12 words before it; each
   is a band: anchor hash and a digest of the paragraph's words. Any WIDTH words
   hold one of the paragraphs of an anchor whole, so two texts that share
   WIDTH words meet in a band, and so do near copies of 50 words and more,
   since between their edits long enough stretches stay.
2. Places of a band are linked with its least place (document, word), which is
   linear in the band. Anchors of one place only end here.
3. Links of one document with another that lie on one diagonal, or near it,
   with gaps of GAP words at most are a run: a passage that may be a repeat.
4. Each run is verified on the words of both texts, AROUND words beyond its
   ends included: stretches of equal words are carried on to their full length
   and joined over edits as long as the passage keeps a Jaccard similarity of
   PERCENT (exact sets of SHINGLE-word shingles); passages have WIDTH words or
   more.
5. A band's least place may share fewer than WIDTH words with the others and so
   hide what these share among themselves. Windows of WIDTH words that hold a
   linked paragraph and stick out of what was verified are compared once more:
   places of one window are linked with the least of them, and verified.
6. The lesser place of a verified pair keeps the passage, in the other its
   words go: the least place of a passage always stays. Passages joined by
   verified pairs form components, each a cluster of removals.

Hot anchors: a sample of about SAMPLE_DOCS documents tells which hold more than
HOT_SHARE of all anchors. Their places are dealt over SALTS keys, and the least
places of these meet in a second round; only the routing depends on the sample.
Nothing is capped, and only the hot anchors' hashes (1 / HOT_SHARE at most) come
to the driver.

Defined cases: null and empty texts and texts shorter than WIDTH words have no
passages. Rows that share an id (null ids too) are one document, each row with
its own text; between them nothing is removed. Inside one text a passage must
lie WIDTH words or more after the place that keeps it, without overlap.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeloom.llm.common import forget, fresh, materialise, rows_of, slices, text_of
from citeloom.llm.components import components
from citeloom.llm.hashing import least, mixed, runs, word_hashes

WIDTH, SHINGLE, PERCENT = 25, 5, 80
GRAM, RUN = 8, 17
PARAGRAPH, OFFSETS, MARK_BITS = 20, (0, 6, 12), 21
GAP, EDIT, AROUND, SKIP = 64, 8, 32, 3
#: Skips (in one text, in the other) tried at an edit, the smallest first.
SKIPS = sorted(((x, y) for x in range(SKIP + 1) for y in range(SKIP + 1) if x or y), key=lambda s: (max(s), sum(s)))
SALTS, SAMPLE_DOCS, HOT_SHARE, HOT_LEAST = 64, 10_000, 1e-4, 64
ROWS_AT_ONCE = 256
LEAST_ID = -(2**63)


# -- candidates --------------------------------------------------------------


def anchors(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, hashes, marks) of a text's anchors; marks pack the digests of the paragraphs, 0 where one doesn't fit."""
    w = word_hashes(text)
    if len(w) < WIDTH:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    v = mixed(runs(w, GRAM))
    # A shingle is an anchor if it is the least of some run that it stands in.
    edge = np.zeros(RUN - 1, np.uint64)
    pos = np.nonzero(~least(~np.concatenate([edge, least(v, RUN), edge]), RUN)[: len(v)] == v)[0]
    if len(pos) * 3 > len(v):  # the same few words again and again: one place of a shingle a run will do
        pos = _thinned(pos, v[pos])
    digest = mixed(runs(w, PARAGRAPH))
    marks = np.zeros(len(pos), np.uint64)
    for k, offset in enumerate(OFFSETS):
        start = pos - offset
        fits = (start >= 0) & (start < len(digest))
        mark = (digest[np.where(fits, start, 0)] >> np.uint64(65 - MARK_BITS)) + np.uint64(1)
        marks |= np.where(fits, mark, np.uint64(0)) << np.uint64(MARK_BITS * k)
    return pos, v[pos].view(np.int64), marks.view(np.int64)


def _thinned(pos: np.ndarray, value: np.ndarray) -> np.ndarray:
    last, kept = {}, []
    for p, v in zip(pos.tolist(), value.tolist(), strict=True):
        if p - last.get(v, -RUN) >= RUN:
            last[v] = p
            kept.append(p)
    return np.array(kept, np.int64)


def anchor_rows(docs: DataFrame) -> DataFrame:
    """(doc, pos, band, marks) of all anchors of docs(doc, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        for batch in batches:
            for at, size in slices(batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, size)
                got = [anchors(t) for t in part.column("text").to_pylist()]
                counts = [len(g[0]) for g in got]
                if sum(counts):
                    pos, band, marks = (np.concatenate(c) for c in zip(*got, strict=True))
                    doc = part.column("doc").take(pa.array(np.repeat(np.arange(size), counts)))
                    yield pa.RecordBatch.from_arrays([doc, pa.array(pos, pa.int32()), pa.array(band), pa.array(marks)], ["doc", "pos", "band", "marks"])

    return docs.mapInArrow(run, "doc long, pos int, band long, marks long")


def hot_anchors(docs: DataFrame) -> list[int]:
    """Hashes of the anchors that hold more than HOT_SHARE of a sample's."""
    share = max(1, docs.count() // SAMPLE_DOCS)
    seen = anchor_rows(docs.filter(F.pmod(F.xxhash64("doc", F.lit(7)), F.lit(share)) == 0) if share > 1 else docs)
    counts = materialise(seen.groupBy("band").count().filter(F.col("count") >= HOT_LEAST), "hot")
    total = counts.agg(F.sum("count")).first()[0] or 0
    out = [r["band"] for r in counts.filter(F.col("count") >= max(HOT_LEAST, HOT_SHARE * total)).select("band").collect()]
    forget(counts)
    return out


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is written, and (doc, start, stop, ldoc, diagonal): words of doc that stand in ldoc too, diagonal words before."""
    salt = F.when(F.col("band").isin(hot), F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")) if (hot := hot_anchors(docs)) else F.lit(None).cast("int")
    rows = anchor_rows(docs).withColumn("salt", F.coalesce(salt, F.lit(-1))).repartition("band", "salt")
    rows = rows.withColumn("places", F.count("*").over(W.partitionBy("band", "salt"))).filter("places > 1 or salt >= 0")
    mark = lambda k: F.shiftrightunsigned("marks", MARK_BITS * k).bitwiseAND((1 << MARK_BITS) - 1)
    bands = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), mark(k).alias("mark"), (F.col("pos") - offset).alias("start")) for k, offset in enumerate(OFFSETS)]))
    rows = rows.select("band", "salt", "doc", "pos", bands.alias("b")).select("band", "salt", "doc", "pos", "b.*").filter("mark <> 0")
    rows = rows.withColumn("lead", F.min(F.struct("doc", "start")).over(W.partitionBy("band", "salt", "kind", "mark")))
    own = (F.col("doc") == F.col("lead.doc")) & (F.col("start") == F.col("lead.start"))
    # Least places go on only where others of their band stand under other salts.
    rows = rows.withColumn("own", own).filter("not own or salt >= 0").withColumn("diagonal", F.col("start") - F.col("lead.start"))
    key = [F.when(F.col("own"), F.col(c)).alias(f"{c}_") for c in ("kind", "mark")]
    rows = rows.groupBy("band", "salt", "doc", "pos", F.col("lead.doc").alias("ldoc"), "diagonal", "own", *key).agg(F.min("start").alias("start"), (F.max("start") + PARAGRAPH).alias("stop"))
    rows = materialise(rows, "links")
    found = rows.filter("not own").select("doc", "start", "stop", "ldoc", "diagonal")
    if hot:
        over = F.min(F.struct("doc", "start")).over(W.partitionBy("band", "kind_", "mark_"))
        roots = rows.filter("own").withColumn("lead", over).filter("doc <> lead.doc or start <> lead.start")
        found = found.unionByName(roots.select("doc", "start", "stop", F.col("lead.doc").alias("ldoc"), (F.col("start") - F.col("lead.start")).alias("diagonal")))
    return rows, found.filter(f"doc <> ldoc or diagonal >= {WIDTH}")


RUN_SCHEMA = "doc long, ldoc long, start int, stop int, lstart int, lstop int, seeds binary"


def candidate_runs(found: DataFrame) -> DataFrame:
    """Links of two documents near one diagonal as one run; seeds: (start, stop, diagonal) of its stretches, as int32."""
    columns = ("doc", "ldoc", "start", "stop", "diagonal")

    def cut(rows: list[np.ndarray], last: bool) -> tuple[pa.RecordBatch | None, list[np.ndarray]]:
        doc, ldoc, start, stop, diagonal = rows
        other = np.ones(len(doc), bool)  # where a run begins
        other[1:] = (np.diff(doc) != 0) | (np.diff(ldoc) != 0) | (start[1:] - stop[:-1] > GAP) | (np.abs(np.diff(diagonal)) > EDIT)
        if not last:  # the last run may go on
            done = int(np.nonzero(other)[0][-1])
            rest, rows = [c[done:] for c in rows], [c[:done] for c in rows]
            doc, ldoc, start, stop, diagonal = rows
            other = other[:done]
        if not len(doc):
            return None, rest
        turn = other.copy()  # where a run or its diagonal changes
        turn[1:] |= np.diff(diagonal) != 0
        at = np.nonzero(turn)[0]
        seeds = np.column_stack([start[at], np.maximum.reduceat(stop, at), diagonal[at]]).astype(np.int32)
        begin = np.nonzero(other[at])[0]
        end = np.append(begin[1:], len(at))
        low, high = seeds[begin], seeds[end - 1]
        raw = [seeds[i:j].tobytes() for i, j in zip(begin.tolist(), end.tolist(), strict=True)]
        lstart = np.minimum.reduceat(seeds[:, 0] - seeds[:, 2], begin)
        lstop = np.maximum.reduceat(seeds[:, 1] - seeds[:, 2], begin)
        out = [pa.array(doc[at[begin]]), pa.array(ldoc[at[begin]]), pa.array(low[:, 0]), pa.array(np.maximum.reduceat(seeds[:, 1], begin)), pa.array(lstart), pa.array(lstop), pa.array(raw, pa.binary())]
        return pa.RecordBatch.from_arrays(out, ["doc", "ldoc", "start", "stop", "lstart", "lstop", "seeds"]), [] if last else rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            now = [batch.column(c).to_numpy() for c in columns]
            held = [np.concatenate(c) for c in zip(held, now, strict=True)] if held else now
            if len(held[0]) > 4096:
                out, held = cut(held, False)
                if out is not None:
                    yield out
        if held and len(held[0]):
            yield cut(held, True)[0]

    return found.select(*columns).repartition("doc").sortWithinPartitions("doc", "ldoc", "start", "diagonal").mapInArrow(run, RUN_SCHEMA)


# -- verification ------------------------------------------------------------


def short(text: str) -> np.ndarray:
    """32-bit hashes of a text's words."""
    return (word_hashes(text) >> np.uint64(32)).astype(np.uint32)


def stretches(a: np.ndarray, b: np.ndarray, seeds: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(place in a, place in b, words) of stretches of SHINGLE equal words or more, along the seeds' diagonals."""
    out, end_a, end_b = [], 0, 0
    for k, (_, _, shift) in enumerate(seeds):
        low = max(end_a, end_b + shift, shift)
        high = min(len(a), len(b) + shift)
        if k + 1 < len(seeds):
            high = min(high, max(seeds[k][1], seeds[k + 1][0]))
        if low >= high:
            continue
        same = a[low:high] == b[low - shift : high - shift]
        if same.all():
            found = [(low, high)] if high - low >= SHINGLE else []
        else:
            edge = np.nonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))[0].reshape(-1, 2)
            found = (edge[edge[:, 1] - edge[:, 0] >= SHINGLE] + low).tolist()
        out += [(i, i - shift, j - i) for i, j in found]
        if found:
            end_a, end_b = found[-1][1], found[-1][1] - shift
    return out


def onward(a: np.ndarray, b: np.ndarray, i: int, j: int) -> list[tuple[int, int, int]]:
    """Stretches of equal words that go on from (i, j), each over an edit of SKIP words at most."""
    out = []
    while True:
        for x, y in SKIPS:
            u, v = i + x, j + y
            size = min(len(a) - u, len(b) - v)
            if size >= SHINGLE and a[u] == b[v] and (a[u : u + SHINGLE] == b[v : v + SHINGLE]).all():
                same = a[u : u + size] == b[v : v + size]
                n = size if same.all() else int(np.argmin(same))
                out.append((u, v, n))
                i, j = u + n, v + n
                break
        else:
            return out


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if min(len(a), len(b)) < SHINGLE:
        return False
    s, t = (np.unique(mixed(runs(x.astype(np.uint64), SHINGLE))) for x in (a, b))
    both = len(np.intersect1d(s, t, assume_unique=True))
    return 100 * both >= PERCENT * (len(s) + len(t) - both)


def similar_passages(a: np.ndarray, b: np.ndarray, seeds: list[tuple[int, int, int]], width: int) -> list[tuple[int, int, int, int]]:
    """(start, stop in a, start, stop in b) of the passages along the seeds that are similar, the longest first tried."""
    parts = stretches(a, b, seeds)
    if parts:  # beyond the seeds the diagonal may change at each edit
        (i, j, _), (k, m, n) = parts[0], parts[-1]
        before = onward(a[:i][::-1], b[:j][::-1], 0, 0)
        parts = [(i - u - x, j - v - x, x) for u, v, x in reversed(before)] + parts + onward(a, b, k + n, m + n)
    out, todo = [], [(0, len(parts))]
    while todo:
        low, high = todo.pop()
        if low == high:
            continue
        (i, j, _), (k, m, n) = parts[low], parts[high - 1]
        if min(k + n - i, m + n - j) < width:
            continue
        if high - low == 1 or similar(a[i : k + n], b[j : m + n]):
            out.append((i, k + n, j, m + n))
            continue
        gaps = [max(y[0] - x[0] - x[2], y[1] - x[1] - x[2]) for x, y in zip(parts[low : high - 1], parts[low + 1 : high], strict=True)]
        cut = low + 1 + max(range(len(gaps)), key=gaps.__getitem__)
        todo += [(low, cut), (cut, high)]
    return out


#: window: null for a verified pair, else the hash of WIDTH words of doc at start that no pair of the link covers;
#: failed: whether no pair touches the stretch it belongs to.
PAIR_SCHEMA = "doc long, tkey long, start int, stop int, ldoc long, ltkey long, lstart int, lstop int, window long, failed boolean"


def uncovered(words: np.ndarray, seeds: list[tuple[int, int, int]], pairs: list[tuple[int, int, int, int]]) -> list[tuple[int, int, bool]]:
    """(start, hash, failed) of windows of WIDTH words that hold a paragraph of a seed and aren't inside a pair's passage."""
    if len(words) < WIDTH:
        return []
    out: dict[int, bool] = {}
    for low, high, _ in seeds:
        first, last = max(0, low - WIDTH + PARAGRAPH), min(high - PARAGRAPH, len(words) - WIDTH)
        open_, touched = [(first, last)], False
        for i, k, _, _ in pairs:  # few, and in order or not
            touched |= i < high and low < k
            open_ = [part for x, y in open_ for part in ((x, min(y, i - 1)), (max(x, k - WIDTH + 1), y)) if part[0] <= part[1]] if i <= last and k - WIDTH >= first else open_
        for x, y in open_:
            for w in range(x, y + 1):
                out[w] = out.get(w, False) or not touched
    if not out:
        return []
    least_, most = min(out), max(out)
    hashes = mixed(runs(words[least_ : most + WIDTH].astype(np.uint64), WIDTH)).view(np.int64)
    return [(w, int(hashes[w - least_]), failed) for w, failed in sorted(out.items())]


def verified_pairs(docs: DataFrame, found: DataFrame, width: int) -> DataFrame:
    """Passages (PAIR_SCHEMA) of doc that stand in ldoc too, of runs found (RUN_SCHEMA); tkey tells texts of one id apart."""
    texts = docs.select("doc", "text", F.xxhash64("text").alias("tkey"))
    # A document's runs are at most a few for each of its anchors.
    listed = found.groupBy("doc").agg(F.collect_list(F.struct("ldoc", "start", "stop", "lstart", "lstop", "seeds")).alias("runs"))
    own_schema = RUN_SCHEMA + ", tkey long, words binary"
    names = [f.split()[0] for f in own_schema.split(", ")]
    types = [pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.binary(), pa.int64(), pa.binary()]

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        out: list[tuple] = []
        make = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
        for doc, text, tkey, mine in rows_of(batches, ("doc", "text", "tkey", "runs"), 64):
            w = short(text)
            for r in mine:
                part = w[max(0, r["start"] - AROUND) : r["stop"] + AROUND]
                out.append((doc, r["ldoc"], r["start"], r["stop"], r["lstart"], r["lstop"], r["seeds"], tkey, part.tobytes()))
            if len(out) >= 2000:
                yield make()
                out = []
        if out:
            yield make()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        known, theirs = None, None
        columns = (*names, "ltkey", "ltext")
        for batch in batches:
            out = []
            for doc, ldoc, start, stop, lstart, lstop, seeds, tkey, words, ltkey, ltext in rows_of([batch], columns, 64):
                if doc == ldoc and tkey != ltkey:
                    continue
                if known != (ldoc, ltkey):
                    known, theirs = (ldoc, ltkey), short(ltext)
                a, low, llow = np.frombuffer(words, np.uint32), max(0, start - AROUND), max(0, lstart - AROUND)
                b = theirs[llow : lstop + AROUND]
                own_seeds = [(s - low, e - low, d + llow - low) for s, e, d in np.frombuffer(seeds, np.int32).reshape(-1, 3).tolist()]
                alike = similar_passages(a, b, own_seeds, width)
                out += [(doc, tkey, w + low, w + low + WIDTH, ldoc, ltkey, None, None, h, f) for w, h, f in uncovered(a, own_seeds, alike)]
                for i, k, j, m in alike:
                    i, k, j, m = i + low, k + low, j + llow, m + llow
                    if doc == ldoc and m > i:  # it runs into itself: as much as doesn't
                        if k - i != m - j or i - j < width:
                            continue
                        k, m = i + (i - j), i
                    out.append((doc, tkey, i, k, ldoc, ltkey, j, m, None, None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), pair_types, strict=True)], pair_names)

    pair_names = [f.split()[0] for f in PAIR_SCHEMA.split(", ")]
    pair_types = [{"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}[f.split()[1]] for f in PAIR_SCHEMA.split(", ")]
    # Both joins move the texts by document, so one exchange serves both; the
    # plan is the same at every size.
    mine = texts.join(listed.hint("merge"), "doc").mapInArrow(own, own_schema)
    theirs = texts.select(F.col("doc").alias("ldoc"), F.col("text").alias("ltext"), F.col("tkey").alias("ltkey"))
    return mine.hint("merge").join(theirs, "ldoc").mapInArrow(check, PAIR_SCHEMA).distinct()


def hidden_links(open_: DataFrame) -> DataFrame:
    """(doc, start, stop, ldoc, diagonal): places of open_(doc, start, window, failed) linked with the least of their window.

    Windows that only verified links leave open are not compared: what lies
    beyond those has bands of its own. Places of a window are spread over SALTS
    keys and meet in two levels.
    """
    rows = open_.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS))).groupBy("window", "salt", "doc", "start").agg(F.bool_or("failed").alias("failed"))
    first = rows.groupBy("window", "salt").agg(F.min(F.struct("doc", "start")).alias("lead"), F.count("*").alias("n"), F.bool_or("failed").alias("failed"))
    root = first.groupBy("window").agg(F.min("lead").alias("lead"), F.sum("n").alias("n"), F.bool_or("failed").alias("failed")).filter("n > 1 and failed").drop("n", "failed")
    met = rows.join(first.select("window", "salt").join(root, "window"), ["window", "salt"])
    met = met.select("doc", "start", (F.col("start") + WIDTH).alias("stop"), F.col("lead.doc").alias("ldoc"), (F.col("start") - F.col("lead.start")).alias("diagonal"))
    return met.filter(f"doc <> ldoc or diagonal >= {WIDTH}")


# -- removals ----------------------------------------------------------------


def joined(places: DataFrame, keys: list[str], name: str) -> DataFrame:
    """places with the first word (name) of the stretch of overlapping places that each lies in."""
    order = W.partitionBy(*keys).orderBy("start", "stop")
    before = F.max("stop").over(order.rowsBetween(W.unboundedPreceding, -1))
    first = F.when(before.isNull() | (F.col("start") >= before), F.col("start"))
    return places.withColumn("first", first).withColumn(name, F.max("first").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("first")


def clusters(pairs: DataFrame) -> DataFrame:
    """(doc, tkey, start, stop, kept, cluster) of all places of the pairs.

    cluster is the least (doc, tkey, node) of the places that pairs and overlaps join.
    """
    text = ["doc", "tkey"]
    taken = pairs.select(*text, "start", "stop").distinct().withColumn("kept", F.lit(False))
    held = pairs.select(F.col("ldoc").alias("doc"), F.col("ltkey").alias("tkey"), F.col("lstart").alias("start"), F.col("lstop").alias("stop")).distinct()
    held = held.withColumn("kept", F.lit(True))
    places = materialise(joined(taken.unionByName(held), text, "node"), "places")
    ends = places.select(*text, "start", "stop", "kept", F.struct(*text, "node").alias("at"))
    one = ends.filter("not kept").select(*text, "start", "stop", F.col("at").alias("a"))
    two = ends.filter("kept").select(F.col("doc").alias("ldoc"), F.col("tkey").alias("ltkey"), F.col("start").alias("lstart"), F.col("stop").alias("lstop"), F.col("at").alias("b"))
    edges = pairs.join(one, [*text, "start", "stop"]).join(two, ["ldoc", "ltkey", "lstart", "lstop"]).select("a", "b").distinct()
    named = components(edges).select("node.doc", "node.tkey", "node.node", F.col("component").alias("cluster"))
    return places.join(named, [*text, "node"], "left").withColumn("cluster", F.coalesce("cluster", F.struct(*text, "node")))


def passages(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc, tkey, first_word, n_words, n_pairs, kept, cluster) of docs(doc, text)."""
    linked, found = links(docs)
    found = materialise(candidate_runs(found), "runs")
    forget(linked)
    judged = materialise(verified_pairs(docs, found, width), "judged")
    forget(found)
    pairs = judged.filter("window is null").drop("window", "failed")
    hidden = materialise(hidden_links(judged.filter("window is not null")), "hidden")
    if not hidden.isEmpty():
        more = materialise(candidate_runs(hidden), "runs")
        pairs = pairs.unionByName(verified_pairs(docs, more, width).filter("window is null").drop("window", "failed")).distinct()
        pairs = materialise(pairs, "pairs")
        forget(judged, more)
    forget(hidden)
    text = ["doc", "tkey"]
    places = joined(clusters(pairs), [*text, "kept"], "span")
    spans = places.groupBy(*text, "kept", "span").agg(F.max("stop").alias("stop"), F.count("*").alias("n_pairs"), F.min("cluster").alias("cluster"))
    spans = materialise(spans, "spans")
    # A place that keeps a passage for others may itself lose it to a lesser one:
    # it counts where a passage's length stays.
    gone = spans.filter("not kept").select(*text, F.col("span").alias("s"), F.col("stop").alias("e"))
    overlap = F.when(F.col("s").isNotNull(), F.greatest(F.lit(0), F.least("e", "stop") - F.greatest("s", "span")))
    held = spans.filter("kept").join(gone, text, "left").groupBy(*spans.columns).agg(F.coalesce(F.sum(overlap), F.lit(0)).alias("lost"))
    held = held.filter(F.col("stop") - F.col("span") - F.col("lost") >= width)
    spans = spans.filter("not kept").unionByName(held.drop("lost"))
    return spans.select(*text, F.col("span").cast("long").alias("first_word"), (F.col("stop") - F.col("span")).cast("long").alias("n_words"), "n_pairs", "kept", "cluster")


def unused_id(docs: DataFrame, id_col: str, most: int = 1000) -> int:
    """The least number that no row has as its id, which stands for null; the ids alone are read."""
    ids = docs.select(docs[id_col].cast("long").alias("id")).filter(F.col("id") < LEAST_ID + most).distinct()
    taken = {r["id"] for r in ids.limit(most).collect()}
    return next(i for i in range(LEAST_ID, LEAST_ID + most + 1) if i not in taken)


def _known(docs: DataFrame, id_col: str, text_col: str, none: int) -> DataFrame:
    return docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(none)).alias("doc"), text_of(docs[text_col]).alias("text"))


def repeats(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of words that stand elsewhere too, one row for each span.

    Returns (id_col, first_word, n_words, keep_id, kept, n_pairs): words are
    runs of non-blank characters, numbered from 0. Overlapping repeats merge
    into one span if they agree on ``kept``: True where this place keeps the
    passage. keep_id is then this document, else the least document of the
    cluster of removals (this one, if the passage stands in it before).
    n_pairs says how many repeats the span was merged of. Documents without
    repeats have no row.
    """
    if width < WIDTH:
        raise ValueError(f"width must be {WIDTH} words or more")
    none = unused_id(docs, id_col)
    real = lambda c: F.when(F.col(c) != none, F.col(c))
    out = passages(_known(docs, id_col, text_col, none), width)
    return out.select(real("doc").alias(id_col), "first_word", "n_words", F.when(F.col("kept"), real("doc")).otherwise(real("cluster.doc")).alias("keep_id"), "kept", "n_pairs")


def remove_repeats(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs, texts without the passages that a lesser place keeps.

    A changed text has its words joined by single blanks; rows without repeats
    are as they were.
    """
    doc, key, spans = (fresh(docs, n) for n in ("doc", "tkey", "spans"))
    none = unused_id(docs, id_col)
    gone = passages(_known(docs, id_col, text_col, none), width).filter("not kept").groupBy(F.col("doc").alias(doc), F.col("tkey").alias(key))
    gone = gone.agg(F.array_sort(F.collect_list(F.struct("first_word", "n_words"))).alias(spans))
    rows = docs.withColumn(doc, F.coalesce(docs[id_col].cast("long"), F.lit(none))).withColumn(key, F.xxhash64(text_of(docs[text_col])))
    met = rows.join(gone, [doc, key], "left")
    tokens = F.filter(F.split(F.col(text_col), r"[\x20\x09-\x0D]+"), lambda t: t != "")
    # The spans lie apart and in order, so what stays are the slices between them.
    start = lambda i: F.when(i > 0, F.try_element_at(F.col(spans), i)["first_word"] + F.try_element_at(F.col(spans), i)["n_words"]).otherwise(F.lit(0))
    between = lambda s, i: F.slice(tokens, (start(i) + 1).cast("int"), (s["first_word"] - start(i)).cast("int"))
    last = start(F.size(spans))
    tail = F.slice(tokens, (last + 1).cast("int"), F.greatest(F.lit(0), F.size(tokens) - last.cast("int")))
    kept = F.concat(F.flatten(F.transform(F.col(spans), between)), tail)
    return met.withColumn(text_col, F.when(F.col(spans).isNotNull(), F.array_join(kept, " ")).otherwise(F.col(text_col))).select(*[F.col(f"`{c}`") for c in docs.columns])
