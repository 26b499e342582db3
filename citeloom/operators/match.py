"""Entity resolution of papers and the match of predictions with ground truth.

Both sides go through the same look-up: an index of both sides' aliases in one
table. Each input is scanned twice, for the index and for the rows. match()
looks up distinct keys, where nothing is hot but papers without any id, which
no index has and which are dealt out by their datasets. The status functions
keep rows, which move twice: to their key's paper, and to the rows of their
paper and dataset. Where a key has so many rows that one task would have them
to itself (crowded), rows meet what is said of their key by (key, part), so
those of one key are spread over PARTS tasks; that moves more.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeloom.functions.identifiers import paper_key, present, synonym_group
from citeloom.session import stored

ALIASES = ("pmcid", "pmid", "paper_doi", "paper_id")
PARTS = 32
PREDICTION, TRUTH = "prediction", "truth"
#: Rows of one key that one task may have besides its share, and the buckets in which they are counted.
MOST_ROWS, BUCKETS = 1_000_000, 4096
#: The key of a paper without any id.
NO_ID = "paper_id:"


def identities(rows: DataFrame, order: str) -> DataFrame:
    """(pmcid, pmid, paper_doi, paper_id, since): the identities of each row, as given, and its number."""
    return rows.select(*ALIASES, F.col(order).alias("since"))


def alias_index(rows: DataFrame, order: str = "row_id") -> DataFrame:
    """(alias, paper): every identity of every row of a paper group.

    Rows group by paper_key(); an alias that several groups hold goes to the
    group that appears last.
    """
    both = index_of(identities(rows, order).withColumn("side", F.lit(TRUTH)))
    return both.select("alias", F.col("truth").alias("paper")).filter("paper is not null")


def index_of(rows: DataFrame) -> DataFrame:
    """(hash, alias, prediction, truth): the paper of an alias on each side, of rows(side, identities, since)."""
    # Rows collapse before they move, and before they are made out: what is left of a paper are its distinct sets of identities,
    # those of both sides one, with the first row that each side has of it.
    first = lambda side: F.min(F.when(F.col("side") == side, F.col("since"))).alias(side)
    held = rows.groupBy(*ALIASES).agg(first(PREDICTION), first(TRUTH))
    held = held.select(PREDICTION, TRUTH, F.array(*[F.concat(F.lit(f"{a}:"), F.lower(present(a))) for a in ALIASES]).alias("aliases"))
    held = hashed(held.withColumn("paper", F.coalesce(*[F.col("aliases")[i] for i in range(len(ALIASES))], F.lit(NO_ID))), "paper")
    # A set that a side does not have gives it no alias, though the side may have the paper.
    since = lambda side: F.when(F.col(side).isNotNull(), F.min(side).over(W.partitionBy("hash", "paper")))
    each = held.withColumns({PREDICTION: since(PREDICTION), TRUTH: since(TRUTH)}).select(PREDICTION, TRUTH, "paper", F.explode("aliases").alias("alias")).filter("alias is not null")
    last = lambda side: F.max(F.when(F.col(side).isNotNull(), F.struct(side, "paper")))["paper"].alias(side)
    return hashed(each, "alias").groupBy("hash", "alias").agg(last(PREDICTION), last(TRUTH))


def hashed(rows: DataFrame, *key: str) -> DataFrame:
    """rows with a hash of their key, which goes before the key in sorts: keys begin with the same letters, and comparing them takes long."""
    return rows.withColumn("hash", F.xxhash64(*key))


def both_indexes(predictions: DataFrame, truth: DataFrame, order: str = "row_id") -> DataFrame:
    """index_of() both sides."""
    sides = ((predictions, PREDICTION), (truth, TRUTH))
    return index_of(reduce(DataFrame.unionByName, [identities(df, order).withColumn("side", F.lit(side)) for df, side in sides]))


def with_papers(keyed: DataFrame, index: DataFrame) -> DataFrame:
    """keyed(own_key, ...) with ``prediction`` and ``truth``: the papers that the index has for own_key, null if none."""
    rows = keyed.withColumn("part", F.pmod(F.hash(*[F.col(c) for c in keyed.columns if c != "own_key"]), F.lit(PARTS)))
    keys = rows.groupBy("own_key", "part").agg(F.lit(1).alias("one"))
    told = keys.select("own_key", "part").join(index.select(F.col("alias").alias("own_key"), PREDICTION, TRUTH), "own_key")
    return rows.join(told, ["own_key", "part"], "left").drop("part")


def paper_of(own_first: bool) -> Column:
    """The paper that a row resolves to, the two sides' papers in the order asked for."""
    order = (PREDICTION, TRUTH) if own_first else (TRUTH, PREDICTION)
    return F.coalesce(*order, "own_key")


def resolve_papers(rows: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """rows with ``paper``: its key looked up in the first index (alias, paper), then the second."""
    both = first.select("alias", F.col("paper").alias(TRUTH)).join(second.select("alias", F.col("paper").alias(PREDICTION)), "alias", "full_outer")
    return with_papers(rows.withColumn("own_key", paper_key()), both).withColumn("paper", paper_of(False)).drop("own_key", PREDICTION, TRUTH)


def group_by_paper(rows: DataFrame, columns: list[str], block_bits: int = 10, order: str = "row_id") -> DataFrame:
    """(paper, part, n, rows): the rows of each paper as a list in order, in parts of at most 2**block_bits numbers.

    A part is a range of row numbers, so no list grows with what one paper has.
    """
    item = F.struct(order, *[c for c in columns if c != order])
    parts = rows.groupBy(paper_key().alias("paper"), F.shiftright(order, block_bits).alias("part"))
    return parts.agg(F.count("*").alias("n"), F.array_sort(F.collect_list(item)).alias("rows"))


def dataset() -> Column:
    return F.lower(F.coalesce("dataset_identifier", F.lit(""))).alias("ds")


def match(predictions: DataFrame, truth: DataFrame, with_repository: bool = False) -> DataFrame:
    """(paper, ds[, repo_group], outcome): TP, FP or FN, of the keys that either side has.

    Both inputs carry the identity columns, dataset_identifier, repository and row_id.
    """
    group = [synonym_group("repository").alias("repo_group")] if with_repository else []
    on = ["paper", "ds", *(["repo_group"] if with_repository else [])]
    keys = [df.select(F.lit(side).alias("side"), paper_key().alias("own_key"), dataset(), *group) for df, side in ((predictions, PREDICTION), (truth, TRUTH))]
    # Distinct before the look-up, so what moves are keys and not rows; both sides' keys are one where they are the same.
    seen_in = lambda: (F.bool_or("in_p").alias("in_p"), F.bool_or("in_t").alias("in_t"))
    marked = keys[0].unionByName(keys[1]).withColumn("in_p", F.col("side") == PREDICTION).withColumn("in_t", F.col("side") == TRUTH)
    distinct = marked.groupBy("own_key", *on[1:]).agg(*seen_in())
    alias = F.when(F.col("own_key") == NO_ID, F.concat(F.lit("-"), F.col("ds"))).otherwise(F.col("own_key"))
    met = hashed(distinct.withColumn("alias", alias), "alias").join(both_indexes(predictions, truth), ["hash", "alias"], "left").withColumn("paper", paper_of(False))
    seen = met.groupBy(*on).agg(*seen_in())
    outcome = F.when(F.col("in_p") & F.col("in_t"), "TP").when(F.col("in_p"), "FP").otherwise("FN")
    return seen.select(*on, outcome.alias("outcome"))


def crowded(rows: DataFrame, *key: str | Column) -> bool:
    """Whether some key has so many rows that they are to be spread. Counted in buckets of keys; whatever is said, results are the same."""
    counts = rows.groupBy(F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).alias("bucket")).count()
    most, total = counts.agg(F.max("count"), F.sum("count")).first()
    return most is not None and most > MOST_ROWS + 4 * total // BUCKETS


def resolved_rows(predictions: DataFrame, truth: DataFrame, carry: dict[str, Callable[[DataFrame], Column]] | None = None) -> DataFrame:
    """(side, row_id, paper, ds, g, ...) of the rows that name a dataset, written.

    g is the repository's group. A row's own side goes before the other in the
    look-up. carry: columns to go along, each made of its side's frame.
    """
    carry = carry or {}
    sides = ((predictions, PREDICTION), (truth, TRUTH))
    rows = [df.select(F.lit(side).alias("side"), "row_id", paper_key().alias("own_key"), dataset(), synonym_group("repository").alias("g"), *[of(df).alias(c) for c, of in carry.items()]).filter("ds not in ('', 'n/a')") for df, side in sides]
    keyed = stored(rows[0].unionByName(rows[1]), "keyed")
    # No index has the papers without any id: they are dealt out by their rows.
    alias = F.when(F.col("own_key") == NO_ID, F.concat(F.lit("-"), F.col("row_id").cast("string"))).otherwise(F.col("own_key"))
    index = both_indexes(predictions, truth)
    if crowded(keyed, alias):
        met = with_papers(keyed, index)
    else:
        met = hashed(keyed.withColumn("alias", alias), "alias").join(index, ["hash", "alias"], "left")
    paper = F.when(F.col("side") == PREDICTION, paper_of(True)).otherwise(paper_of(False))
    return stored(met.select("side", "row_id", paper.alias("paper"), "ds", "g", *carry), "resolved")


def judged(rows: DataFrame) -> DataFrame:
    """Resolved rows of both sides with ``status`` and ``picked``, the truth row that a prediction picks."""
    if crowded(rows, "paper", "ds"):
        return prediction_rows(rows).unionByName(truth_rows(rows))
    # One move by paper and dataset serves both windows.
    at_pair, at_group = W.partitionBy("hash", "paper", "ds"), W.partitionBy("hash", "paper", "ds", "g")
    predicted, row = F.col("side") == PREDICTION, F.when(F.col("side") == TRUTH, F.col("row_id"))
    told = hashed(rows.repartition("paper", "ds"), "paper", "ds").withColumns({"first": F.min(row).over(at_group), "wanted": F.bool_or(predicted).over(at_group)})
    told = told.withColumns({"any": F.min(row).over(at_pair), "predicted": F.bool_or(predicted).over(at_pair), "astray": F.bool_or(predicted & F.col("first").isNull()).over(at_pair)})
    of_prediction = F.when(F.col("any").isNull(), "FP").when(F.col("first").isNotNull(), "TP").otherwise("REPO-MISMATCH")
    picked = (F.col("wanted") & (F.col("row_id") == F.col("first"))) | (F.col("astray") & (F.col("row_id") == F.col("any")))
    of_truth = F.when(picked, "TP").when(F.col("predicted"), "REPO-MISMATCH").otherwise("FN")
    made = {"status": F.when(predicted, of_prediction).otherwise(of_truth), "picked": F.when(predicted, F.coalesce("first", "any"))}
    return told.withColumns(made).drop("hash", "first", "wanted", "any", "predicted", "astray")


def group_tallies(rows: DataFrame) -> DataFrame:
    """(paper, ds, part, p_groups, t_groups, first_of): what each dataset of a paper has on either side, for each part of its rows.

    p_groups and t_groups are the repository groups, t_groups with the first truth row of each.
    """
    # Rows first become one for each group, which are few.
    held = rows.groupBy("paper", "ds", "side", "g").agg(F.min("row_id").alias("first"))
    of = lambda side, value: F.collect_set(F.when(F.col("side") == side, value))
    return held.groupBy("paper", "ds").agg(of(PREDICTION, F.col("g")).alias("p_groups"), of(TRUTH, F.struct("g", "first")).alias("t_firsts"), F.min(F.when(F.col("side") == TRUTH, F.col("first"))).alias("any"))


def assignments(rows: DataFrame) -> DataFrame:
    """(paper, ds, g, same, picked): what predictions of group g pick among the truth rows of their paper and dataset.

    The first row of their group (same), else the first at all; nothing where there is none.
    """
    each = group_tallies(rows).select("paper", "ds", "any", "t_firsts", F.explode("p_groups").alias("g"))
    own = F.try_element_at(F.filter("t_firsts", lambda t: t["g"] == F.col("g")), F.lit(1))["first"]
    return each.select("paper", "ds", "g", own.isNotNull().alias("same"), F.coalesce(own, "any").alias("picked"))


def spread_join(rows: DataFrame, told: DataFrame, on: list[str]) -> DataFrame:
    """rows with what told (unique by ``on``) says, null if nothing; rows of one key are spread over PARTS tasks."""
    rows = rows.withColumn("part", F.pmod(F.hash("row_id"), F.lit(PARTS)))
    keys = rows.groupBy(*on, "part").agg(F.lit(1).alias("one")).drop("one")
    return rows.join(keys.join(told, on), [*on, "part"], "left").drop("part")


def prediction_status(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """(row_id, paper, ds, status) of predictions that name a dataset.

    TP if a truth row has the pair and the repository's group, REPO-MISMATCH if
    only the pair, else FP. Here a prediction's own index goes before the truth's.
    """
    return judged(resolved_rows(predictions, truth)).filter(F.col("side") == PREDICTION).select("row_id", "paper", "ds", "status")


def prediction_rows(rows: DataFrame) -> DataFrame:
    """The predictions among resolved rows with status and picked, those of one key spread."""
    met = spread_join(rows.filter(F.col("side") == PREDICTION), assignments(rows), ["paper", "ds", "g"])
    status = F.when(F.col("picked").isNull(), "FP").when(F.col("same"), "TP").otherwise("REPO-MISMATCH")
    return met.select(*rows.columns, status.alias("status"), "picked")


def truth_status(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """(row_id, paper, ds, status) of truth rows that name a dataset.

    A prediction picks the first truth row of its paper and dataset that has
    its repository's group, else the first of them at all. TP if a row is
    picked, REPO-MISMATCH if only its paper and dataset are predicted, else FN.
    """
    return judged(resolved_rows(predictions, truth)).filter(F.col("side") == TRUTH).select("row_id", "paper", "ds", "status")


def truth_rows(rows: DataFrame) -> DataFrame:
    """The truth rows among resolved rows with status, those of one key spread; they pick nothing."""
    told = assignments(rows).groupBy("paper", "ds").agg(F.collect_set("picked").alias("picks"))
    met = spread_join(rows.filter(F.col("side") == TRUTH), told, ["paper", "ds"])
    status = F.when(F.array_contains("picks", F.col("row_id")), "TP").when(F.col("picks").isNotNull(), "REPO-MISMATCH").otherwise("FN")
    return met.select(*rows.columns, status.alias("status"), F.lit(None).cast(rows.schema["row_id"].dataType).alias("picked"))


def status_tally(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """(side, status, n) of predictions and truth rows.

    What prediction_status() and truth_status() say of each row, counted. Rows
    collapse to one for each key, dataset and repository group before they
    move, so no key is hot; a group's numbers of rows and its first truth row
    tell how many of its rows have which status.
    """
    sides = ((predictions, PREDICTION), (truth, TRUTH))
    rows = [df.select(F.lit(side).alias("side"), "row_id", paper_key().alias("own_key"), dataset(), synonym_group("repository").alias("g")).filter("ds not in ('', 'n/a')") for df, side in sides]
    predicted = F.col("side") == PREDICTION
    counts = F.count_if(predicted).alias("p_n"), F.count_if(~predicted).alias("t_n"), F.min(F.when(~predicted, F.col("row_id"))).alias("first")
    held = rows[0].unionByName(rows[1]).groupBy("own_key", "ds", "g").agg(*counts)
    alias = F.when(F.col("own_key") == NO_ID, F.concat(F.lit("-"), F.col("ds"))).otherwise(F.col("own_key"))
    met = hashed(held.withColumn("alias", alias), "alias").join(both_indexes(predictions, truth), ["hash", "alias"], "left")
    # A side's own index goes first, so a key's predictions and truth rows may be of two papers.
    of = lambda paper, p_n, t_n, first: F.struct(paper.alias("paper"), p_n.alias("p_n"), t_n.alias("t_n"), first.alias("first"))
    p_n, t_n, first, none = F.col("p_n"), F.col("t_n"), F.col("first"), F.lit(0).cast("long")
    apart = F.array(of(paper_of(True), p_n, none, F.lit(None).cast(held.schema["first"].dataType)), of(paper_of(False), none, t_n, first))
    one = F.array(of(F.when(p_n > 0, paper_of(True)).otherwise(paper_of(False)), p_n, t_n, first))
    each = met.select("ds", "g", F.explode(F.when((p_n > 0) & (t_n > 0) & (paper_of(True) != paper_of(False)), apart).otherwise(one)).alias("e")).select("ds", "g", "e.*")
    groups = each.repartition("paper", "ds").groupBy("paper", "ds", "g").agg(F.sum("p_n").alias("p_n"), F.sum("t_n").alias("t_n"), F.min("first").alias("first"))
    # Predictions whose group has no truth row pick the first of all, which is counted already if its own group is predicted.
    both, astray = (p_n > 0) & (t_n > 0), F.bool_or((p_n > 0) & (t_n == 0)) & (F.min_by("p_n", "first") == 0)
    pairs = groups.groupBy("paper", "ds").agg(F.sum("p_n").alias("p"), F.sum("t_n").alias("t"), F.sum(F.when(both, p_n).otherwise(0)).alias("p_tp"), (F.count_if(both) + F.coalesce(astray, F.lit(False)).cast("long")).alias("t_tp"))
    p, t = F.col("p"), F.col("t")
    numbers = {
        (PREDICTION, "TP"): F.col("p_tp"), (PREDICTION, "REPO-MISMATCH"): F.when(t > 0, p - F.col("p_tp")), (PREDICTION, "FP"): F.when(t == 0, p),
        (TRUTH, "TP"): F.col("t_tp"), (TRUTH, "REPO-MISMATCH"): F.when(p > 0, t - F.col("t_tp")), (TRUTH, "FN"): F.when(p == 0, t),
    }
    total = pairs.agg(*[F.sum(n).alias(f"n{i}") for i, n in enumerate(numbers.values())])
    listed = F.array(*[F.struct(F.lit(side).alias("side"), F.lit(status).alias("status"), F.col(f"n{i}").alias("n")) for i, (side, status) in enumerate(numbers)])
    return total.select(F.inline(listed)).filter("n > 0")
