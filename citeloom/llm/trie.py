"""Prefix trie of conversations (operator 13).

1. Turns are dictionary-encoded: equal (role, text) have one number, and from
   here on only numbers and word counts travel. The dictionary joins rows by
   (part, digest), so a turn that a third of all conversations hold is spread.
2. Conversations are sequences of turn numbers. Equal ones become one with a
   count, the least id and the digest of their ids, so copies cost nothing more.
3. Distributed MSD radix passes: a bucket holds the sequences with one prefix.
   A pass finds the prefix that all of a bucket share beyond it (that of its
   least and its largest sequence), emits the nodes along it, and deals the
   bucket by the turn that follows. Buckets of LOCAL_TURNS turns at most are
   local; larger ones go through the next pass, however skewed they are.
4. Local buckets are finished by multikey quicksort, one after the other in a
   task: three-way partitions by the turn at a depth, the recursion emitting a
   node for each group of equal turns.
5. Totals of subtrees: each local bucket and each node run of the passes knows
   the buckets above it, and one aggregation adds them up.

Passes end after as many branchings as the largest buckets have on one path; a
shared run of turns takes one pass whatever its length. Bounds: a task holds one
local bucket, or one sequence where that alone is larger. A conversation's own
turns are one array. The ids that end at one node are digested in their order,
from blocks of BLOCK ids, in one task but never in memory at once (SHA-256 has
no other way).

Defined cases: null turns go first; null roles and texts count as empty; turns
of one number go by the digest of role and text, repeated rows are repeated
turns. Rows with a null conversation id are one conversation, which no other is
rebuilt from; it has no part in the least ids, and among ids it comes last, as
``null``. An empty table has no node, not even the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import forget, materialise, prepare, rows_of, text_of

WORD = r"[^\x20\x09-\x0D]+"
SALTS, BLOCK_BITS, LOCAL_TURNS = 16, 10, 1 << 16
NOTHING = hashlib.sha256().hexdigest()


# -- sequences ---------------------------------------------------------------


def encoded(turns: DataFrame) -> DataFrame:
    """turns(conv, turn, role, text) as (conv, seen, turn, digest, token, words): token numbers equal (role, text)."""
    said = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    rows = turns.select("conv", F.col("turn").isNotNull().alias("seen"), "turn", F.unhex(F.sha2(said, 256)).alias("digest"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("conv"), F.lit(SALTS)).cast("int"))
    held = rows.groupBy("part", "digest").agg(F.max("words").alias("words"))
    # Written, so the numbers hold for good.
    numbers = materialise(held.groupBy("digest").agg(F.max("words").alias("words")).withColumn("token", F.monotonically_increasing_id()), "turns")
    told = held.select("part", "digest").join(numbers.select("digest", "token"), "digest")
    return rows.join(told, ["part", "digest"]).drop("part")


def sequences(coded: DataFrame) -> DataFrame:
    """(conv, tokens, words): a conversation's turns in order, as two arrays."""
    turn = F.struct("seen", "turn", "digest", "token", "words")
    listed = coded.groupBy("conv").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    return listed.select("conv", F.transform("t", lambda t: t["token"]).alias("tokens"), F.transform("t", lambda t: t["words"]).alias("words"))


def rebuilt(seqs: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """Sequences whose first turns are those of conversation conv - conv % family, h of them; h: crc32 of the id % most."""
    donors = seqs.filter(F.col("conv") % family == 0).select(F.col("conv").alias("donor"), F.slice("tokens", 1, most - 1).alias("t"), F.slice("words", 1, most - 1).alias("w"))
    # A donor is rebuilt from itself, which leaves it as it is.
    own = seqs.withColumn("donor", F.when(F.col("conv") % family != 0, F.col("conv") - F.col("conv") % family)).withColumn("h", F.when(F.col("conv") % family != 0, F.crc32(F.col("conv").cast("string")) % most).otherwise(0).cast("int"))
    met = own.join(donors, "donor", "left")
    none = F.array().cast("array<long>")
    whole = lambda first, mine: F.concat(F.slice(F.coalesce(first, none), F.lit(1), F.col("h")), F.slice(mine, F.col("h") + 1, F.greatest(F.lit(0), F.size(mine) - F.col("h"))))
    return met.select("conv", whole(F.col("t"), F.col("tokens")).alias("tokens"), whole(F.col("w"), F.col("words")).alias("words"))


def collapsed(seqs: DataFrame) -> DataFrame:
    """Distinct sequences (tokens, words, n, conv, ends): how often, the least id, the digest of all ids."""
    keyed = seqs.withColumn("k1", F.xxhash64("tokens", F.size("tokens"))).withColumn("k2", F.xxhash64(F.reverse("tokens"), F.lit(1)))
    keyed = materialise(keyed, "sequences")
    distinct = keyed.groupBy("k1", "k2").agg(F.min(F.struct("tokens", "words")).alias("s"), F.count("*").alias("n"), F.min("conv").alias("conv"))
    digests = ends_digests(keyed.select("k1", "k2", "conv"))
    return distinct.join(digests, ["k1", "k2"]).select("s.tokens", "s.words", "n", "conv", "ends")


def ends_digests(members: DataFrame) -> DataFrame:
    """(k1, k2, ends): SHA-256 of the comma-joined ids of members(k1, k2, conv), in numerical order, null last."""
    block = F.shiftright("conv", BLOCK_BITS)
    # Ids are distinct, so a block has a bounded number of them.
    blocks = members.groupBy("k1", "k2", F.col("conv").isNull().alias("no"), block.alias("block")).agg(F.array_sort(F.collect_list("conv")).alias("ids"))
    text = F.when(F.col("no"), "null").otherwise(F.array_join(F.transform("ids", lambda i: i.cast("string")), ","))
    listed = blocks.select("k1", "k2", "no", "block", text.alias("text")).repartition("k1", "k2").sortWithinPartitions("k1", "k2", "no", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, out = None, None, []
        for k1, k2, text in rows_of(batches, ("k1", "k2", "text")):
            if (k1, k2) != key:
                if key is not None:
                    out.append((*key, digest.hexdigest()))
                key, digest = (k1, k2), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(text.encode())
            if len(out) >= 10_000:
                yield table(out)
                out = []
        if key is not None:
            yield table([*out, (*key, digest.hexdigest())])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        a, b, c = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.string())], ["k1", "k2", "ends"])

    return listed.mapInArrow(run, "k1 long, k2 long, ends string")


# -- nodes -------------------------------------------------------------------

#: A sequence in a bucket: what is left of it behind the bucket's prefix; last: the words of the prefix's last turn.
BUCKET = ("b1", "b2", "depth", "last", "parent", "path", "tokens", "words", "n", "conv", "ends")
NODE = "conv long, depth long, parent long, n_convs long, n_children long, n_leaves long, saved long, ends string"


def local_nodes(held: list[tuple], depth: int, last: int, parent: int | None) -> list[list]:
    """Nodes (NODE) of the trie over sequences (tokens, words, n, conv, ends) that go on from one prefix.

    The prefix has depth turns, the last of them so many words. Multikey
    quicksort: a group is parted at the turn at its depth into less, equal and
    greater; the equal ones are a child, the others are parted on. The first
    node is the prefix, and children follow their parents.
    """
    out, above, todo = [], [], [(held, 0, parent, -1)]
    while todo:
        group, d, up, row = todo.pop()
        n = sum(s[2] for s in group)
        conv = min((s[3] for s in group if s[3] is not None), default=None)
        ended = [s for s in group if len(s[0]) == d]
        own = (n - 1) * (group[0][1][d - 1] if d else last)
        node, at = [conv, depth + d, up, n, 0, 0, own, ended[0][4] if ended else NOTHING], len(out)
        out.append(node)
        above.append(row)
        parts = [[s for s in group if len(s[0]) > d] if ended else group]
        while parts:
            part = parts.pop()
            if not part:
                continue
            pivot = part[len(part) // 2][0][d]
            less, equal, more = [], [], []
            for s in part:
                (equal if s[0][d] == pivot else less if s[0][d] < pivot else more).append(s)
            node[4] += 1
            todo.append((equal, d + 1, conv, at))
            parts += [less, more]
    for node, row in zip(reversed(out), reversed(above), strict=True):
        node[5] += node[4] == 0
        if row >= 0:
            out[row][5] += node[5]
            out[row][6] += node[6]
    return out


def finished(local: DataFrame) -> DataFrame:
    """Nodes of local buckets (BUCKET); path stays with the top nodes only."""
    schema = pa.schema([(f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in NODE.split(", ")] + [("path", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []

        def close() -> None:
            made = local_nodes(held, *key[2:5])
            out.extend([*node, None] for node in made)
            out[-len(made)][-1] = key[5]

        for row in rows_of(batches, BUCKET):
            if row[:2] != (key and key[:2]):
                if key is not None:
                    close()
                    if len(out) >= 20_000:
                        yield table(out)
                        out.clear()
                key, held = row[:6], []
            held.append(row[6:])
        if key is not None:
            close()
        if out:
            yield table(out)

    def table(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    # A path is read again only where totals are added up.
    dealt = local.withColumn("path", F.to_json("path")).select(*BUCKET).repartition("b1", "b2").sortWithinPartitions("b1", "b2")
    return dealt.mapInArrow(run, NODE + ", path string")


def shared(low: Column, high: Column) -> Column:
    """How many elements two arrays share at their start."""
    first = F.array_position(F.zip_with(low, high, lambda x, y: ~x.eqNullSafe(y)), True)
    return F.when(first > 0, first - 1).otherwise(F.least(F.size(low), F.size(high))).cast("int")


def prefix_trie(seqs: DataFrame, local_turns: int = LOCAL_TURNS) -> DataFrame:
    """Nodes (NODE) of the trie over the sequences (conv, tokens, words), an id at most once.

    n_leaves and saved are those of whole subtrees, saved being the sum of each
    node's (n_convs - 1) times the words of its last turn.
    """
    path, zero = "array<struct<b1:bigint,b2:bigint>>", F.lit(0).cast("long")
    opened = collapsed(seqs).select(zero.alias("b1"), zero.alias("b2"), zero.alias("depth"), zero.alias("last"), F.lit(None).cast("long").alias("parent"), F.array().cast(path).alias("path"), "tokens", "words", "n", "conv", "ends")
    opened, local, runs = materialise(opened, "open"), [], []
    key, same = ["b1", "b2"], [F.first(c).alias(c) for c in ("depth", "last", "parent", "path")]
    while True:
        sized = opened.groupBy(*key).agg(F.sum(F.size("tokens")).alias("turns"), F.min(F.struct("tokens", "words", "ends")).alias("lo"), F.max("tokens").alias("hi"), F.sum("n").alias("n"), F.min("conv").alias("conv"), *same)
        # The first pass deals the root, however small.
        large = sized.filter(F.col("turns") > local_turns) if runs else sized
        large = large.withColumn("stop", shared(F.col("lo.tokens"), F.col("hi"))).withColumn("leaf", F.size("hi") == F.col("stop"))
        large = materialise(large.drop("hi", "turns"), "runs")
        if large.isEmpty():
            local.append(opened)
            forget(large)
            break
        told = large.select(*key, "stop", F.col("conv").alias("up"))
        marked = materialise(opened.join(told, key, "left"), "marked")
        forget(opened)
        if runs:
            local.append(marked.filter("stop is null").select(*BUCKET))
        onward = marked.filter("size(tokens) > stop").withColumn("turn", F.element_at("tokens", F.col("stop") + 1))
        rest = lambda c: F.slice(c, F.col("stop") + 2, F.greatest(F.lit(0), F.size(c) - F.col("stop") - 1)).alias(c)
        onward = onward.select(
            F.xxhash64(*key, "turn").alias("b1"), F.xxhash64("turn", F.lit(1), *key).alias("b2"), (F.col("depth") + F.col("stop") + 1).alias("depth"), F.element_at("words", F.col("stop") + 1).alias("last"), F.col("up").alias("parent"),
            F.concat("path", F.array(F.struct(*key))).alias("path"), rest("tokens"), rest("words"), "n", "conv", "ends",
        )
        opened = materialise(onward, "open")
        runs.append(large)
    below = materialise(_union([finished(x) for x in local]), "nodes")
    nodes = below.drop("path")
    return nodes.unionByName(run_nodes(_union(runs), below)) if runs else nodes


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def run_nodes(runs: DataFrame, below: DataFrame) -> DataFrame:
    """Nodes (NODE) of the runs that the passes found: from a bucket's prefix to where it branches, stop turns on.

    runs: (b1, b2, lo, n, conv, depth, last, parent, path, stop, leaf); below: the local nodes, the tops with their paths.
    """
    key, zero = ["b1", "b2"], F.lit(0).cast("long")
    total = lambda words: (F.col("n") - 1) * F.aggregate(words, zero, lambda a, x: a + x)
    runs = runs.withColumn("words", F.concat(F.array("last"), F.slice("lo.words", F.lit(1), F.col("stop"))))
    tops = below.filter("path is not null").select(F.from_json("path", "array<struct<b1:bigint,b2:bigint>>").alias("path"), "n_leaves", "saved")
    each = tops.unionByName(runs.select("path", F.col("leaf").cast("long").alias("n_leaves"), total(F.col("words")).alias("saved")))
    # Everything counts for all runs above it, and as a child for the last of them.
    spread = each.select("n_leaves", "saved", F.size("path").alias("size"), F.posexplode("path").alias("i", "k"))
    totals = spread.groupBy("k.b1", "k.b2").agg(F.sum("n_leaves").alias("leaves"), F.sum("saved").alias("under"), F.count_if(F.col("i") + 1 == F.col("size")).alias("children"))
    met = runs.join(totals, key, "left").fillna(0, ["leaves", "under", "children"])
    at = met.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("stop"))))
    # A run's last node branches; the others have one child each.
    branches = F.col("i") == F.col("stop")
    saved = F.col("under") + total(F.slice("words", F.col("i") + 1, F.col("stop") - F.col("i") + 1))
    ends = F.when(branches & (F.size("lo.tokens") == F.col("stop")), F.col("lo.ends")).otherwise(NOTHING)
    return at.select(
        "conv", (F.col("depth") + F.col("i")).alias("depth"), F.when(F.col("i") == 0, F.col("parent")).otherwise(F.col("conv")).alias("parent"), F.col("n").alias("n_convs"), F.when(branches, F.col("children")).otherwise(1).cast("long").alias("n_children"),
        (F.col("leaves") + F.col("leaf").cast("long")).alias("n_leaves"), saved.alias("saved"), ends.alias("ends"),
    )


def conversation_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", rebuild: bool = True, local_turns: int = LOCAL_TURNS) -> DataFrame:
    """The prefix trie of conversations, one row for each distinct sequence of first turns.

    Returns (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256): a node is named by its least member and its
    depth. With rebuild, the first turns are those of the conversation that
    leads a family of 20, as rebuilt() says.
    """
    prepare(conversations.sparkSession)
    c = conversations
    turns = c.select(c[conv_col].cast("long").alias("conv"), c[turn_col].alias("turn"), text_of(c[role_col]).alias("role"), text_of(c[text_col]).alias("text"))
    seqs = sequences(encoded(turns))
    if rebuild:
        seqs = rebuilt(materialise(seqs, "turns"))
    nodes = prefix_trie(seqs, local_turns)
    return nodes.select(F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))
