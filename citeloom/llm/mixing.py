"""Mixing sources to target weights by entropy balancing (operator 11).

1. A document's size is its number of words. Sources take weights in turn and
   share a budget; a source whose share passes ``most`` times its size stops
   there and what it leaves over goes to the others by weight (targets()).
2. Of all rates that meet the targets, entropy balancing takes those nearest to
   one copy of each document in relative entropy. The convex dual has one
   multiplier a source, and a document's rate is the exponential tilt
   min(most, exp(multiplier * size / scale)). Newton's iterations solve it, each
   an aggregation over the table of (source, size, documents), which is all that
   rates depend on; a bracket takes over where a step leaves it.
3. Rates become copies. Sizes of a source go from the largest down, each size
   group gets the whole number of copies nearest to its share, and what is over
   or under goes on to the next size, so a source ends within about its smallest
   document of its target. In a group the copies fall to documents by the order
   of a hash; groups are split into SALTS parts, so none is one task's work.

Sums run over whole numbers (rates in units of 2**-32), so they don't depend on
the order of rows and reruns agree to the last copy.

Bounds: a source has at most sqrt(2 * its words) different sizes, which bounds
what step 3 holds of one source. The list of sources (one row each) is sorted in
one task. Nothing else leaves the executors but one row of totals a round.

Defined cases: null texts have size 0; null is a source of its own, the last.
Documents of size 0 take nothing and get one copy (``most`` where all documents
of their source do). Rows that repeat count each. An empty table gives none.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeloom.llm.common import forget, fresh, materialise, text_of

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
SALTS, ROUNDS, CLOSE, UNIT = 64, 80, 1e-7, 1 << 32


def sizes(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """(id, source, at, size, k1, k2, salt): ``at`` names a source, null too; k1 and k2 tell rows apart."""
    rows = docs.select(docs[id_col].alias("id"), docs[source_col].cast("string").alias("source"), text_of(docs[text_col]).alias("text"))
    rows = rows.select("id", "source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("at"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("size"), *row_hashes("id", "source", "text"))
    return rows.withColumn("salt", F.pmod("k1", F.lit(SALTS)).cast("int"))


def row_hashes(*columns: str) -> tuple[Column, Column]:
    return F.xxhash64(*columns).alias("k1"), F.xxhash64(*reversed(columns), F.lit(1)).alias("k2")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sources(at, source, source_size) with weight and target (words)."""
    in_order = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sources.withColumn("weight", F.element_at(F.lit(list(weights)), (in_order % len(weights) + 1).cast("int")).cast("double"))
    # Sources stop in the order of size to weight; level is what a unit of weight is worth once those before have
    # stopped. It holds at the first source that it leaves below its end; behind that one it only falls.
    cap, stops = F.col("source_size") * F.lit(float(most)), W.orderBy(F.col("source_size") / F.col("weight"), "at")
    before = F.coalesce(F.sum(cap).over(stops.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(stops.rowsBetween(W.currentRow, W.unboundedFollowing))
    everything = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = weighed.withColumn("level", (F.sum("source_size").over(everything) * F.lit(share) - before) / rest)
    level = level.withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= cap, F.col("level"))).over(everything))
    return level.withColumn("target", F.coalesce(F.least(cap, F.col("level") * F.col("weight")), cap)).drop("level")


def rate(tilt: Column, size: Column, scale: Column, full: Column, most: int = MOST) -> Column:
    """Copies a document should have, in units of 1 / UNIT."""
    tilted = F.exp(F.least(tilt * size / scale, F.lit(50.0)))
    return F.when(full, F.lit(most * UNIT)).otherwise(F.floor(F.least(tilted, F.lit(float(most))) * UNIT)).cast("long")


def balance(groups: DataFrame, aims: DataFrame, most: int = MOST, close: float = CLOSE, rounds: int = ROUNDS) -> DataFrame:
    """(at, target, scale, full, tilt): the multiplier of each source of aims(at, source_size, target).

    groups: (at, size, docs). A source is done when its words under the rates
    are within ``close`` of its target, relatively, or its bracket is spent.
    """
    exact = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
    words = exact("size", 12) * exact("docs", 12)
    square = groups.groupBy("at").agg(F.try_divide(F.sum(words * exact("size", 12)).cast("double"), F.sum(words).cast("double")).alias("scale"))
    number = lambda x: F.lit(x).cast("double")
    state = aims.select("at", "source_size", "target").join(square, "at", "left").select(
        "at", "source_size", "target", F.greatest(F.coalesce("scale", F.lit(1.0)), F.lit(1.0)).alias("scale"), (F.col("target") >= F.col("source_size") * F.lit(float(most))).alias("full"),
        number(0.0).alias("tilt"), number(None).alias("low"), number(None).alias("high"),
    )
    state = materialise(state.withColumn("done", F.col("full")), "tilts")
    for _ in range(rounds):
        if state.filter("not done").isEmpty():
            break
        met = groups.join(state.filter("not done"), "at").withColumn("rate", rate(F.col("tilt"), F.col("size"), F.col("scale"), F.col("full"), most))
        # Where the rate stands at its most it doesn't follow the multiplier.
        slope = F.when(F.col("rate") < most * UNIT, words * exact("rate", 14) * exact("size", 12))
        sums = met.groupBy("at").agg(F.sum(words * exact("rate", 14)).alias("got"), F.sum(slope).alias("slope"))
        over = F.col("got").cast("double") / UNIT - F.col("target")
        now = state.join(sums, "at", "left").withColumn("over", over).withColumn("gain", F.col("slope").cast("double") / UNIT / F.col("scale"))
        now = now.withColumn("high", F.when(F.col("over") > 0, F.col("tilt")).otherwise(F.col("high"))).withColumn("low", F.when(F.col("over") < 0, F.col("tilt")).otherwise(F.col("low")))
        newton = F.col("tilt") - F.try_divide("over", "gain")
        inside = newton.isNotNull() & (newton > F.coalesce("low", F.lit(float("-inf")))) & (newton < F.coalesce("high", F.lit(float("inf")))) & (F.abs(newton - F.col("tilt")) <= 4 + F.abs("tilt"))
        beyond = F.when(F.col("over") > 0, F.col("tilt") - 2 - F.abs("tilt")).otherwise(F.col("tilt") + 2 + F.abs("tilt"))
        step = F.when(inside, newton).otherwise(F.coalesce((F.col("low") + F.col("high")) / 2, beyond))
        spent = F.coalesce(F.col("high") - F.col("low") <= 1e-14 * F.abs("tilt"), F.lit(False))
        met_it = F.coalesce(F.abs("over") <= F.lit(close) * F.greatest("target", F.lit(1.0)), F.lit(True)) | spent
        ready = F.col("done") | met_it
        before, state = state, materialise(now.select("at", "source_size", "target", "scale", "full", F.when(ready, F.col("tilt")).otherwise(step).alias("tilt"), "low", "high", ready.alias("done")), "tilts")
        forget(before)
    return state.select("at", "source_size", "target", "scale", "full", "tilt")


def whole_copies(rated: pd.DataFrame, most: int = MOST) -> pd.DataFrame:
    """Copies of each size group of one source (at, size, docs, rate), from the largest size down, the rest handed on."""
    rated = rated.sort_values("size", ascending=False)
    over, out = 0.0, []
    for size, docs, r in zip(rated["size"].tolist(), rated["docs"].tolist(), (rated["rate"] / UNIT).tolist(), strict=True):
        if size == 0:
            out.append(round(docs * r))
            continue
        due = docs * r * size + over
        n = min(max(round(due / size), 0), most * docs)
        over = due - n * size
        out.append(n)
    return rated[["at", "size", "docs"]].assign(copies=out)


def mixing_plan(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """How often each row goes into the mix.

    Returns (id_col, source, size, source_size, target, rate, copies, taken, k1,
    k2): rate is what the balance asks for, copies the whole number that it
    became, taken = copies * size.
    """
    rows = materialise(sizes(docs, id_col, source_col, text_col), "sizes")
    parts = materialise(rows.groupBy("at", "size", "salt").agg(F.count("*").alias("docs")), "parts")
    groups = materialise(parts.groupBy("at", "size").agg(F.sum("docs").alias("docs")), "groups")
    held = rows.groupBy("at").agg(F.max("source").alias("source"), F.sum("size").alias("source_size"))
    aims = materialise(targets(held, weights, share, most), "aims")
    tilts = balance(groups, aims, most)
    rated = groups.join(tilts, "at").select("at", "size", "docs", rate(F.col("tilt"), F.col("size"), F.col("scale"), F.col("full"), most).alias("rate"))
    counted = rated.groupBy("at").applyInPandas(lambda frame: whole_copies(frame, most), "at string, size long, docs long, copies long")
    counted = counted.withColumn("base", F.expr("copies div docs")).withColumn("more", F.col("copies") % F.col("docs"))
    # What a group has beyond the same for all goes to its parts in turn.
    told = parts.select("at", "size", "salt", F.col("docs").alias("here")).join(counted.select("at", "size", "base", "more"), ["at", "size"])
    before = F.coalesce(F.sum("here").over(W.partitionBy("at", "size").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    told = materialise(told.withColumn("more", F.greatest(F.lit(0), F.least(F.col("here"), F.col("more") - before))).drop("here"), "copies")
    place = F.row_number().over(W.partitionBy("at", "size", "salt").orderBy("k1", "k2"))
    met = rows.withColumn("place", place).join(told, ["at", "size", "salt"]).join(tilts, "at")
    copies = F.col("base") + F.when(F.col("place") <= F.col("more"), 1).otherwise(0)
    asked = rate(F.col("tilt"), F.col("size"), F.col("scale"), F.col("full"), most) / F.lit(float(UNIT))
    out = met.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", asked.alias("rate"), copies.alias("copies"), "k1", "k2")
    return out.withColumn("taken", F.col("copies") * F.col("size")).select(id_col, "source", "size", "source_size", "target", "rate", "copies", "taken", "k1", "k2")


def mixture(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **plan) -> DataFrame:
    """The mix: rows of docs (all columns), each as often as mixing_plan() says."""
    one, two, n, at = (fresh(docs, c) for c in ("k1", "k2", "copies", "at"))
    told = mixing_plan(docs, id_col, source_col, text_col, **plan).groupBy("k1", "k2").agg(F.sum("copies").alias("n")).filter("n > 0")
    text = text_of(docs[text_col])
    rows = docs.withColumn(one, F.xxhash64(docs[id_col], docs[source_col].cast("string"), text)).withColumn(two, F.xxhash64(text, docs[source_col].cast("string"), docs[id_col], F.lit(1)))
    # Of rows that repeat one stands for all.
    rows = rows.withColumn(at, F.row_number().over(W.partitionBy(one, two).orderBy(F.lit(0)))).filter(F.col(at) == 1)
    met = rows.join(told.select(F.col("k1").alias(one), F.col("k2").alias(two), F.col("n").alias(n)), [one, two])
    return met.withColumn(at, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*[F.col(f"`{c}`") for c in docs.columns])
