"""From nested extraction rows to flat, checked, de-duplicated predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.identifiers import first_of, evidence_inconsistent, infer_known, is_na, let, normalize_identifier, normalize_repository, synonym_group, url_known, validate_identifier, with_normalized
from citeloom.functions.registry import NA

HEADER = ("paper_id", "paper_doi", "pmcid", "pmid")
ITEM = ("dataset_identifier", "repository", "evidence", "confidence", "notes")
EVIDENCE_CHARS = 500
ITEMS = "array<struct<dataset_identifier:string,repository:string,evidence:string,confidence:string,notes:string>>"


def text(item: Column, name: str) -> Column:
    return F.coalesce(item[name], F.lit(""))


def given(item: Column) -> Column:
    """The identifier of a reference, normalized."""
    return F.when(is_na(item["dataset_identifier"]), F.lit(NA)).otherwise(normalize_identifier(item["dataset_identifier"]))


def named(item: Column) -> Column:
    """The repository that a reference names, normalized; "" if none."""
    return F.when(is_na(item["repository"]), F.lit("")).otherwise(normalize_repository(item["repository"]))


def inferred(given: Column, named: Column) -> Column:
    return F.when(given == NA, F.when(named == "", NA).otherwise(named)).otherwise(infer_known(given, named))


def made_of(item: Column, given: Column, repo: Column) -> Column:
    missing, evidence = given == NA, F.left(text(item, "evidence"), F.lit(EVIDENCE_CHARS))
    good = missing | (validate_identifier(given, repo) & ~evidence_inconsistent(given, evidence))
    return F.struct(
        given.alias("dataset_identifier"), repo.alias("repository"), F.when(missing, "").otherwise(url_known(given, repo)).alias("url"), evidence.alias("evidence"),
        F.when(missing, "").otherwise(text(item, "confidence")).alias("confidence"), text(item, "notes").alias("notes"),
        F.concat(F.lower(given), F.lit("\x01"), F.when(missing & (repo == NA), F.lit("")).otherwise(synonym_group(repo))).alias("key"), good.alias("good"),
    )


def normalized(item: Column) -> Column:
    """One reference as a prediction struct with its de-duplication key and verdict."""
    return let(given(item), lambda g: let(let(named(item), lambda n: inferred(g, n)), lambda r: made_of(item, g, r)))


def na_row() -> Column:
    fields = [F.lit(NA).alias("dataset_identifier"), F.lit(NA).alias("repository"), *[F.lit("").alias(n) for n in ("url", "evidence", "confidence", "notes")], F.lit("").alias("key"), F.lit(True).alias("good")]
    return F.struct(*fields)


def first_of_each(items: Column) -> Column:
    """Array elements whose key no earlier element has."""
    return first_of(items, lambda r: r["key"])


def flatten_references(raw: DataFrame, refs: str = "dataset_references") -> DataFrame:
    """One row for each reference kept; a paper without any gives one N/A row.

    All of it happens inside the row: no shuffle. inline_outer is used because
    plain inline would make the optimizer repeat the whole array expression in
    a filter.
    """
    header = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in HEADER]
    made = raw.select(*header, F.transform(F.coalesce(F.col(refs).cast(ITEMS), F.array().cast(ITEMS)), normalized).alias("all"))
    good = made.select(*HEADER, F.filter("all", lambda r: r["good"]).alias("good"))
    kept = good.select(*HEADER, first_of_each(F.col("good")).alias("kept"))
    some = kept.select(*HEADER, F.when(F.size("kept") > 0, F.col("kept")).otherwise(F.array(na_row())).alias("kept"))
    return some.select(*HEADER, F.inline_outer("kept")).drop("key", "good")


def flatten_by_window(rows: DataFrame, order: str = "pos") -> DataFrame:
    """The same over rows (header, item columns, order), for very long lists.

    First occurrences come from row_number() over (paper, key), which Spark
    limits before it shuffles. Each reference is normalized once. Along with it
    goes an N/A row without a key; of a paper's N/A rows the first stays, those
    of good references first, and is dropped if it is one of these.
    """
    from pyspark.sql import Window as W

    item = F.struct(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in ITEM])
    # In steps, so that each value is computed once, in generated code.
    steps = with_normalized(rows.select(*HEADER, order, item.alias("item")), "item.dataset_identifier", "item.repository", "given", "named", "").withColumn("repo", inferred(F.col("given"), F.col("named")))
    made = steps.select(*HEADER, order, made_of(F.col("item"), F.col("given"), F.col("repo")).alias("r"))
    none = na_row().withField("key", F.lit(None).cast("string")).withField("good", F.col("r.good"))
    each = made.select(*HEADER, order, F.explode(F.when(F.col("r.good"), F.array("r", none)).otherwise(F.array(none))).alias("r"))
    first = F.row_number().over(W.partitionBy(*HEADER, "r.key").orderBy(F.col("r.good").desc(), order))
    kept = each.withColumn("n", first).filter("n = 1 and (r.key is not null or not r.good)")
    return kept.select(*HEADER, "r.*").drop("key", "good")
