"""MinHash near-duplicates with sequential Bayesian verification (operator 6).

1. Each text becomes its set of distinct word shingles. Equal sets collapse to
   one representative (the least id), so exact copies cost nothing further.
2. MinHash values are cut into bands; representatives that agree on a band are
   candidates. Buckets of one are dropped and buckets of the same members are
   one bucket before anything heavier than ids is joined.
3. Candidates are compared by their signatures, batch by batch. With a uniform
   prior, m matches of n leave P(similarity >= t) = P(Bin(n + 1, t) <= m); a
   pair is pruned as soon as that falls below ``miss``. Survivors are verified
   on the full sets.
4. First each member of a bucket is compared with the bucket's leader (its
   least id), which is linear in the bucket and settles most of it: the links
   give components, the leader has no pair left, and a bucket whose other
   members are of one component is done.
5. In what is left all pairs between different components are compared in
   memory, blocks of a large bucket being spread over tasks. Pairs are not
   emitted: of the survivors only a maximum spanning forest is, since pairs
   inside one verified tree add nothing to the components. Where one of these
   fails verification, the forest may have hidden a link, so its bucket is gone
   through once more with the full sets at hand: every surviving pair between
   components is verified there, and a forest of the links is emitted.
6. Verified links give components.

Chance of missing a link: bands miss a pair of similarity 0.8 with probability
(1 - 0.8**6)**32 = 6e-5 and fewer above; each of six comparisons adds 1e-6.

Defined cases: null and empty texts and texts without words have the empty set
and link with nothing; a text of fewer words than a shingle has its whole
sequence as one shingle. Rows with a null id link through equal sets only. If
an id repeats with different texts, those count as one node.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.llm.common import forget, fresh, materialise, rows_of, slices, text_of
from citeloom.llm.components import components
from citeloom.llm.hashing import ODD, mixed, word_hashes

ROWS_AT_ONCE = 256
BLOCK = 2048
MATRIX_CELLS = 4 << 20
SALTS = 64


@dataclass(frozen=True)
class Plan:
    """Parameters of a similarity run."""

    words: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 6
    batch: int = 32
    miss: float = 1e-6

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    def least_matches(self) -> list[tuple[int, int]]:
        """(values compared, matches a pair needs to stay) after each batch."""
        out, t = [], self.percent / 100
        for n in [*range(self.batch, self.hashes, self.batch), self.hashes]:
            below, m = 0.0, 0
            while m <= n and (below := below + math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)) < self.miss:
                m += 1
            out.append((n, m))
        return out


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles, A-Z lower-cased."""
    w = word_hashes(text)
    if not len(w):
        return np.empty(0, np.uint64)
    size = min(words, len(w))
    m = len(w) - size + 1
    h = np.full(m, np.uint64(size), np.uint64)
    for i in range(size):
        h = h * ODD + w[i : i + m]
    return np.unique(mixed(h))


class Hasher:
    def __init__(self, plan: Plan):
        self.plan = plan
        seeds = np.array([xxhash.xxh64_intdigest(f"minhash {i}".encode()) for i in range(plan.hashes)], np.uint64)
        self.times = (seeds >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        self.plus = seeds.astype(np.uint32)
        self.salt = mixed(np.arange(1, plan.bands + 1, dtype=np.uint64) * ODD)

    def values(self, hashes: np.ndarray) -> np.ndarray:
        x = (hashes >> np.uint64(16)).astype(np.uint32)
        out = np.full(self.plan.hashes, 0xFFFFFFFF, np.uint32)
        for at, size in slices(len(x), 1024):
            table = np.multiply.outer(self.times, x[at : at + size])
            table += self.plus[:, None]
            np.minimum(out, table.min(axis=1), out=out)
        return out

    def keys(self, values: np.ndarray) -> np.ndarray:
        h = self.salt.copy()
        for column in values.reshape(self.plan.bands, self.plan.rows).T:
            h = h * ODD + column
        return mixed(h).view(np.int64)

    @staticmethod
    def brief(values: np.ndarray) -> bytes:
        """One byte of each value, enough to compare."""
        return ((values * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


def signatures(items: DataFrame, plan: Plan) -> DataFrame:
    """(id, n, low, high, brief, keys) of items(id, text)."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("low", T.LongType()), T.StructField("high", T.LongType()), T.StructField("brief", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        hasher = Hasher(plan)
        for batch in batches:
            for at, size in slices(batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, size)
                n, low, high, brief, keys = [], [], [], [], []
                for text in part.column("text").to_pylist():
                    s = shingle_set(text, plan.words)
                    a, b = np.frombuffer(xxhash.xxh128_digest(s.tobytes()), "<i8").tolist()
                    n.append(len(s))
                    low.append(a)
                    high.append(b)
                    values = hasher.values(s) if len(s) else None
                    brief.append(None if values is None else hasher.brief(values))
                    keys.append(None if values is None else hasher.keys(values))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(brief, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], schema.names)

    return items.mapInArrow(run, schema)


# -- inside a bucket ---------------------------------------------------------


def survivors(a: np.ndarray, b: np.ndarray | None, steps: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row pairs that no batch prunes, with their matches; b None: pairs within a.

    While many pairs of a stretch of rows are left they are compared column by
    column as a matrix, then one by one.
    """
    other = a if b is None else b
    out = []
    for at, size in slices(len(a), max(1, MATRIX_CELLS // max(1, len(other)))):
        rows = a[at : at + size]
        count, open_ = np.zeros((len(rows), len(other)), np.uint8), None
        if b is None:
            open_ = np.arange(len(other))[None, :] > (at + np.arange(len(rows)))[:, None]
        i = j = few = None
        done = 0
        for n, least in steps:
            if i is None:
                for c in range(done, n):
                    count += (rows[:, c, None] == other[None, :, c]).view(np.uint8)
                stay = count >= least if open_ is None else (count >= least) & open_
                open_ = stay
                if np.count_nonzero(stay) * 20 < stay.size or n == steps[-1][0]:
                    i, j = np.nonzero(stay)
                    few = count[i, j].astype(np.int64)
            else:
                for s, k in slices(len(i), 1 << 16):
                    few[s : s + k] += np.count_nonzero(rows[i[s : s + k], done:n] == other[j[s : s + k], done:n], axis=1)
                stay = few >= least
                i, j, few = i[stay], j[stay], few[stay]
            done = n
        out.append((i + at, j, few))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def forest(labels: np.ndarray, i: np.ndarray, j: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which pairs form a maximum spanning forest over the labels (Boruvka's rounds)."""
    _, comp = np.unique(labels, return_inverse=True)
    order = weight.astype(np.int64) * (len(i) + 1) + np.arange(len(i))  # no ties
    alive, chosen = np.arange(len(i)), []
    while True:
        x, y = comp[i[alive]], comp[j[alive]]
        apart = x != y
        alive, x, y = alive[apart], x[apart], y[apart]
        if not len(alive):
            return np.array(sorted(chosen), np.int64)
        best = np.full(comp.max() + 1, -1, np.int64)
        np.maximum.at(best, x, order[alive])
        np.maximum.at(best, y, order[alive])
        picked = np.unique(best[best >= 0]) % (len(i) + 1)
        root: dict[int, int] = {}

        def find(c: int, root: dict[int, int] = root) -> int:
            while (up := root.get(c, c)) != c:
                c = up
            return c

        for k in picked.tolist():
            u, v = find(int(comp[i[k]])), find(int(comp[j[k]]))
            if u != v:
                root[max(u, v)] = min(u, v)
                chosen.append(k)
        comp = np.array([find(c) for c in range(comp.max() + 1)], np.int64)[comp]


def exact_links(sets: list[bytes], i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which of the pairs are links, by exact intersections, one row against all at a time."""
    sizes = np.array([len(s) // 8 for s in sets])
    _, codes = np.unique(np.frombuffer(b"".join(sets), np.uint64), return_inverse=True)
    ends = np.cumsum(sizes)
    begins, mark = ends - sizes, np.zeros(codes.max() + 1, bool)
    if len(np.unique(i)) > len(np.unique(j)):
        i, j = j, i
    out, order = np.zeros(len(i), bool), np.argsort(i, kind="stable")
    rows, at = np.unique(i[order], return_index=True)
    for row, mine in zip(rows.tolist(), np.split(order, at[1:]), strict=True):
        own = codes[begins[row] : ends[row]]
        mark[own] = True
        if len(mine) * 4 > len(sets):
            both = np.add.reduceat(mark[codes], begins, dtype=np.int64)[j[mine]]
        else:
            both = np.array([np.count_nonzero(mark[codes[begins[k] : ends[k]]]) for k in j[mine].tolist()])
        mark[own] = False
        out[mine] = 100 * both >= percent * (sizes[row] + sizes[j[mine]] - both)
    return out


def bucket_pairs(rows: DataFrame, plan: Plan) -> DataFrame:
    """Pairs (key, i, j, a, b) from units of rows.

    rows: (key, i, j, block, id, label, brief, hashes): a unit (key, i, j)
    holds the pairs between blocks i and j of bucket key; pairs of one label
    are left out. Without hashes the pairs are the forest of what survives the
    comparison of signatures, with them that of the survivors that are links.
    """
    schema = "key long, i int, j int, a long, b long"
    steps = plan.least_matches()

    def work(unit: tuple, held: list[tuple]) -> list[tuple]:
        if len(held) < 2:
            return []
        if len(held) == 2 and held[0][4] is None:
            (_, x, u, first, _), (_, y, v, second, _) = held
            if x == y or u == v:
                return []
            same = np.frombuffer(first, np.uint8) == np.frombuffer(second, np.uint8)
            return [(*unit, min(x, y), max(x, y))] if all(np.count_nonzero(same[:n]) >= m for n, m in steps) else []
        brief = np.frombuffer(b"".join([r[3] for r in held]), np.uint8).reshape(len(held), -1)
        block, ids, labels = (np.array(c, np.int64) for c in zip(*[r[:3] for r in held], strict=True))
        if unit[1] == unit[2]:
            i, j, count = survivors(brief, None, steps)
        else:
            first, second = np.nonzero(block == unit[1])[0], np.nonzero(block == unit[2])[0]
            if not len(first) or not len(second):
                return []
            i, j, count = survivors(brief[first], brief[second], steps)
            i, j = first[i], second[j]
        apart = (labels[i] != labels[j]) & (ids[i] != ids[j])
        i, j, count = i[apart], j[apart], count[apart]
        if held[0][4] is not None and len(i):
            link = exact_links([r[4] for r in held], i, j, plan.percent)
            i, j, count = i[link], j[link], count[link]
        if not len(i):
            return []
        k = forest(labels, i, j, count)
        a, b = ids[i[k]], ids[j[k]]
        return [(*unit, *p) for p in zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        unit, held, out = None, [], []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["key", "i", "j", "a", "b"])

        for row in rows_of(batches, columns):
            if row[:3] != unit:
                if unit is not None:
                    out += work(unit, held)
                unit, held = row[:3], []
            held.append(row[3:])
            if len(out) >= 10_000:
                yield batch_of(out)
                out = []
        if unit is not None:
            out += work(unit, held)
        if out:
            yield batch_of(out)

    columns = ("key", "i", "j", "block", "id", "label", "brief", "hashes")
    return rows.select(*columns).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, schema)


# -- verification ------------------------------------------------------------


def text_sets(items: DataFrame, plan: Plan) -> DataFrame:
    """(id, hashes): the full shingle set of each item, sorted, as binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, size in slices(batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, size)
                sets = [shingle_set(t, plan.words).tobytes() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sets, pa.binary())], ["id", "hashes"])

    return items.mapInArrow(run, "id long, hashes binary")


def verified(pairs: DataFrame, sets: DataFrame, plan: Plan) -> DataFrame:
    """(a, b, linked) of every distinct pair, by exact intersection and union."""
    one, two = (sets.select(F.col("id").alias(c), F.col("hashes").alias(f"s{c}")) for c in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, y in rows_of([batch], ("sa", "sb")):
                s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                out.append(both > 0 and 100 * both >= plan.percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, pa.bool_())], ["a", "b", "linked"])

    met = pairs.select("a", "b").distinct().join(one, "a").join(two, "b").select("a", "b", "sa", "sb")
    return met.mapInArrow(run, "a long, b long, linked boolean").groupBy("a", "b").agg(F.bool_or("linked").alias("linked"))


def likely(pairs: DataFrame, briefs: DataFrame, plan: Plan) -> DataFrame:
    """The pairs (a, b) that no batch of their signatures prunes; briefs: (id, brief)."""
    one, two = (briefs.select(F.col("id").alias(c), F.col("brief").alias(f"s{c}")) for c in "ab")
    steps = plan.least_matches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, plan.hashes) for c in ("sa", "sb"))
            left, count, done = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64), 0
            for n, least in steps:
                count[left] += np.count_nonzero(x[left, done:n] == y[left, done:n], axis=1)
                left, done = left[count[left] >= least], n
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(left)) for c in "ab"], ["a", "b"])

    return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long").distinct()


def same_sets(signed: DataFrame) -> DataFrame:
    """(id, n, rep) of rows (id, n, low, high) with a set: the least id of each set.

    Copies of one set are spread over SALTS keys and meet in two levels, so a
    set with a third of all rows gives no task more than its share.
    """
    sets = ["low", "high", "n"]
    rows = signed.select("id", *sets, F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt"))
    first = rows.groupBy("salt", *sets).agg(F.min("id").alias("least"))
    root = first.groupBy(*sets).agg(F.min("least").alias("rep"))
    told = first.select("salt", *sets).join(root, sets)
    return rows.join(told, ["salt", *sets]).select("id", *sets, "rep")


def similar_components(items: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """(id, n, component) for every row of items(id long, text string).

    n is the size of the shingle set. component is the least id that links
    reach, the row's own included; rows with empty sets are their own.
    """
    items = items.select("id", text_of("text").alias("text"))
    signed = materialise(signatures(items, plan), "signed")
    known_sets = signed.filter("n > 0")
    empty = signed.filter("n = 0").select("id", "low", "high", "n", F.lit(None).cast("long").alias("rep"))
    owned = materialise(same_sets(known_sets).unionByName(empty), "owned")
    # A representative is found by its own id, so a set with many copies is no hot key.
    lead = ["id", "low", "high", "n"]
    reps = known_sets.join(owned.filter("id = rep").select(*lead), lead, "left_semi")
    reps = materialise(reps.select("id", "brief", "keys").dropDuplicates(["id", "brief"]), "reps")
    forget(signed)
    briefs, banded = reps.select("id", "brief"), reps.select("id", F.explode("keys").alias("key"))
    mark = lambda seed: F.bit_xor(F.xxhash64("id", F.lit(seed)))
    buckets = banded.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("lead"), mark(1).alias("x"), mark(2).alias("y")).filter("size > 1")
    # Buckets of the same members, told by two 64-bit sums of them, are one.
    buckets = buckets.groupBy("size", "lead", "x", "y").agg(F.min("key").alias("key"))
    met = materialise(banded.join(buckets.select("key", "lead"), "key"), "members")
    members = met.filter("id <> lead")
    # The texts of all members are read once, for their full sets. The ids grow
    # with the input, so the join is the same at every size: no broadcast.
    wanted = members.select(F.explode(F.array("id", "lead")).alias("id")).distinct()
    known = materialise(text_sets(items.join(wanted.hint("merge"), "id", "left_semi"), plan), "sets")
    judged = verified(likely(members.select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct(), briefs, plan), known, plan)
    labels = components(judged.filter("linked").select("a", "b"))
    # The leaders have no pair left; what they have brought together needs none.
    rest = labelled(members, labels)
    if not rest.isEmpty():
        sized = rest.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        spread = rest.join(sized, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        unit = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j")))
        placed = materialise(spread.select("key", "block", "id", "label", F.explode(unit).alias("u")).select("key", "u.i", "u.j", "block", "id", "label"), "placed")
        none = F.lit(None).cast("binary")
        pairs = materialise(bucket_pairs(placed.join(briefs, "id").withColumn("hashes", none), plan), "pairs")
        judged = materialise(verified(pairs, known, plan), "judged")
        labels = further(labels, judged.filter("linked").select("a", "b"))
        open_ = pairs.join(judged.filter("not linked"), ["a", "b"]).select("key", "i", "j").distinct()
        hidden = labelled(placed.drop("label").join(open_, ["key", "i", "j"], "left_semi"), labels, ("key", "i", "j"))
        if not hidden.isEmpty():
            labels = further(labels, materialise(bucket_pairs(hidden.join(briefs, "id").join(known, "id"), plan), "more").select("a", "b"))
        forget(placed, pairs, judged)
    forget(reps, met, known, rest)
    out = owned.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left")
    return out.select("id", "n", F.coalesce("component", "rep", "id").alias("component"))


def further(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, component) after more links (a, b); the components so far are stars to begin with."""
    if links.isEmpty():
        return labels
    return components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links))


def labelled(members: DataFrame, labels: DataFrame, unit: tuple[str, ...] = ("key",)) -> DataFrame:
    """members with the component of each (label), of units that hold several components."""
    named = labels.select(F.col("node").alias("id"), F.col("component").alias("label"))
    rows = materialise(members.join(named, "id", "left").withColumn("label", F.coalesce("label", "id")), "labelled")
    several = rows.groupBy(*unit).agg(F.min("label").alias("l"), F.max("label").alias("h")).filter("l <> h").select(*unit)
    return materialise(rows.join(several, list(unit), "left_semi"), "several")


def near_groups(docs: DataFrame, plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id, kept) of every row."""
    out = similar_components(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), plan)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def near_dedup(docs: DataFrame, plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows (all columns) that stay: the least id of each component."""
    name = fresh(docs, "stay")
    stay = near_groups(docs, plan, id_col, text_col).filter("kept").select(F.col(id_col).alias(name)).distinct()
    return docs.join(stay, docs[id_col].eqNullSafe(stay[name]), "left_semi")
