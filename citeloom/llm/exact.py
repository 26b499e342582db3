"""Exact deduplication (operator 8), DataFrame operations only.

A tree merge of sorted digest runs. Rows are dealt to ``runs`` runs by a hash of
their id, so copies of one text spread over all runs. In a run, sorted by
digest, a text is one entry (digest, best id, rows). Runs then merge in binomial
rounds, FAN_IN of them at a time: those whose numbers agree but for the last
bits are exchanged, merged in the order of digests, and of a digest's entries
the one with the best id stays, with the sum of their rows, until one run is
left. Texts are digested once; what is written and goes on are their digests. A run is spread over all partitions by
digest, so the last round is no single task. The way back goes down the same
tree: the final entry of a digest meets at most ``runs`` entries of the first
level, and each of those meets the rows of its own run only. No step joins or
groups a hot text's rows by its digest alone, so a text with a third of all rows
costs each task a 1/(3 * runs) share at most.

An entry's key is the SHA-256 digest and, to verify it, the byte length and an
independent 64-bit hash: two texts share an entry only if all three agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeloom.llm.common import fresh, materialise, text_of

RUNS, FAN_IN = 64, 4


def merge_runs(entries: DataFrame, keys: list[str], best: str, runs: int, fan_in: int, largest: bool) -> DataFrame:
    """Merge sorted entries (run, keys, best, rows) round by round down to one run, fan_in runs at a time."""
    order = F.col(best).desc_nulls_last() if largest else F.col(best).asc_nulls_last()
    while runs > 1:
        runs = -(-runs // fan_in)
        entries = entries.withColumn("run", F.expr(f"run div {fan_in}").cast("int"))
        same = W.partitionBy("run", *keys)
        entries = entries.withColumn("place", F.row_number().over(same.orderBy(order))).withColumn("rows", F.sum("rows").over(same))
        entries = entries.filter("place = 1").drop("place")
    return entries


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Column | None = None, keep: str = "largest", runs: int = RUNS, fan_in: int = FAN_IN) -> DataFrame:
    """One row for each input row: its group's keeper, size and own fate.

    Returns (id_col, keep_id, group_size, kept, text_sha256). Texts are equal
    when their normalised forms are (``normalise``: a Column over the text,
    none by default); null counts as empty. Of equal texts the row with the
    ``keep`` ("largest" or "smallest") id stays; a null id stays only if all
    ids of its group are null. If rows repeat with the id that stays, exactly
    one of them is kept.
    """
    largest = keep == "largest"
    text = text_of(docs[text_col]) if normalise is None else F.coalesce(normalise, F.lit(""))
    rows = docs.select(docs[id_col].alias("id"), text.alias("t")).select("id", F.sha2("t", 256).alias("digest"), F.octet_length("t").alias("bytes"), F.xxhash64("t").alias("check"))
    keys = ["digest", "bytes", "check"]
    rows = rows.withColumn("run", F.pmod(F.xxhash64("id"), F.lit(runs)).cast("int"))
    rows = materialise(rows, "digests").repartition("run", *keys)
    in_run = W.partitionBy("run", *keys)
    order = F.col("id").desc_nulls_last() if largest else F.col("id").asc_nulls_last()
    rows = rows.withColumn("at", F.row_number().over(in_run.orderBy(order))).withColumn("rows", F.count("*").over(in_run))
    first = rows.filter("at = 1").select("run", *keys, F.col("id").alias("best"), F.col("rows").alias("rows"))
    final = merge_runs(first, keys, "best", runs, fan_in, largest).select(*keys, F.col("best").alias("keep_id"), F.col("rows").alias("group_size"))
    # Down the tree: the root meets the first level's entries, those their rows.
    told = first.select("run", *keys).join(final, keys)
    met = rows.select("id", "run", "at", *keys).join(told, ["run", *keys])
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("at") == 1)
    return met.select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Column | None = None, keep: str = "largest") -> DataFrame:
    """The input's rows (all columns) whose row stays; see exact_groups().

    A repeated (id, text) row is kept once.
    """
    key, digest, at = (fresh(docs, n) for n in ("key", "digest", "at"))
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    fate = exact_groups(docs, id_col, text_col, normalise, keep)
    stay = fate.filter("kept").select(known(id_col).alias(key), F.col("text_sha256").alias(digest))
    text = text_of(docs[text_col]) if normalise is None else F.coalesce(normalise, F.lit(""))
    # Join and window share their keys, so the texts are shuffled once.
    kept = docs.withColumn(key, known(id_col)).withColumn(digest, F.sha2(text, 256)).join(stay, [key, digest], "left_semi")
    numbered = kept.withColumn(at, F.row_number().over(W.partitionBy(key, digest).orderBy(F.lit(0))))
    return numbered.filter(F.col(at) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
