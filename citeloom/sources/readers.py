"""Readers of papers, ground truth, predictions and URL lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeloom.functions.identifiers import classify_url, is_na, normalize_doi, normalize_identifier, normalize_repository, present, slug, strip
from citeloom.functions.registry import NA
from citeloom.operators.sections import decoded
from citeloom.sources import fetch as paced

PAPER_FILES = r"(?i)\.(html?|n?xml|pdf)$"
#: Column names that ground-truth files use, by field, in order (fixed values).
COLUMNS = {
    "paper_id": ("paper_id", "article_id", "source_article_id"),
    "pmcid": ("pmcid", "PMCID", "pmc_id", "PMC_ID"),
    "pmid": ("pmid", "PMID"),
    "doi": ("doi", "DOI", "paper_doi", "article_doi"),
    "dataset_identifier": ("dataset_identifier", "dataset_id", "accession", "accession_number", "identifier", "id"),
    "repository": ("repository", "repo", "database", "source", "data_repository"),
    "url": ("url", "URL", "link", "dataset_webpage", "dataset_url", "repo_link"),
    "paper_url": ("citing_publication_link", "publication_link", "paper_url", "article_url", "source_url"),
}


def paper_files(spark: SparkSession, folder: str, least_bytes: int = 0) -> DataFrame:
    """(source_path, paper_id, length, content) of the paper files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    stem = F.regexp_extract("path", r"([^/]+)\.[^.]*$", 1)
    return files.filter(F.col("path").rlike(PAPER_FILES) & (F.col("length") >= least_bytes)).select(F.col("path").alias("source_path"), stem.alias("paper_id"), "length", F.col("content").alias("bytes"))


def paper_texts(files: DataFrame) -> DataFrame:
    """(content, paper_id, source_path) of the files that are not PDF; bytes that are not UTF-8 are left out."""
    text = files.filter(~F.col("source_path").rlike(r"(?i)\.pdf$"))
    return text.select(decoded(F.col("bytes")).alias("content"), "paper_id", "source_path")


def has_papers(spark: SparkSession, folder: str) -> bool:
    return not paper_files(spark, folder, 101).limit(1).isEmpty()


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """CSV, TSV, JSON lines or JSON (an array, or an object with rows), all columns strings."""
    low = path.lower()
    if low.endswith((".csv", ".tsv")):
        df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("sep", "\t" if low.endswith(".tsv") else ",").csv(path)
        return df.toDF(*[c.lstrip("﻿") for c in df.columns])
    if low.endswith((".jsonl", ".ndjson")):
        return spark.read.option("primitivesAsString", True).json(path)
    if low.endswith(".json"):
        df = spark.read.option("multiLine", True).option("primitivesAsString", True).json(path)
        return df.select(F.explode("rows").alias("r")).select("r.*") if df.columns == ["rows"] else df
    if low.endswith(".parquet"):
        return spark.read.parquet(path)
    raise ValueError(f"unknown kind of file: {path}")


RESCUED = "_rescued"


def read_ragged(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of a CSV, TSV or JSON lines file whose records may not fit, all columns strings.

    No record is lost. A line of too few or too many cells is a row, with nulls
    for what it lacks, and has its raw text in the column RESCUED, null for all
    others. A JSON line may have any fields of any type, nested ones as JSON. A
    line that is no record at all is a reject only. rejects (raw, reason) lists
    every record that did not fit: short, bare (one cell only), long, or broken.
    """
    low = path.lower()
    if low.endswith((".csv", ".tsv")):
        sep = "\t" if low.endswith(".tsv") else ","
        given = spark.read.option("header", True).option("escape", '"').option("sep", sep).csv(path)
        names = [c.lstrip("\ufeff") for c in given.columns]
        quoted = ", ".join(f"`{c}` string" for c in [*names, RESCUED])
        rows = spark.read.schema(quoted).option("header", True).option("enforceSchema", True).option("escape", '"').option("sep", sep).option("mode", "PERMISSIVE").option("columnPruning", False).option("columnNameOfCorruptRecord", RESCUED).csv(path)
        extra = F.from_csv(F.col(RESCUED), ", ".join(f"c{i} string" for i in range(len(names) + 1)), {"sep": sep, "escape": '"'})[f"c{len(names)}"]
        reason = F.when(extra.isNotNull(), "long").when(F.col(f"`{names[0]}`").eqNullSafe(F.col(RESCUED)), "bare").otherwise("short")
        return rows, rows.filter(F.col(RESCUED).isNotNull()).select(F.col(RESCUED).alias("raw"), reason.alias("reason"))
    if low.endswith((".jsonl", ".ndjson")):
        lines = spark.read.text(path).filter(strip("value") != "").select("value", F.try_parse_json("value").alias("v"))
        whole = F.schema_of_variant("v").startswith("OBJECT")
        fields = lines.filter(whole).select(F.explode(F.map_keys(F.from_json("value", "map<string,string>"))).alias("k")).distinct().orderBy("k")
        names = [r["k"] for r in fields.collect()]
        values = F.from_json("value", "map<string,string>")
        rows = lines.filter(whole).withColumn("m", values).select(*[F.col("m")[n].alias(n) for n in names], F.lit(None).cast("string").alias(RESCUED))
        return rows, lines.filter(~F.coalesce(whole, F.lit(False))).select(F.col("value").alias("raw"), F.lit("broken").alias("reason"))
    raise ValueError(f"unknown kind of file: {path}")


def pick(df: DataFrame, field: str) -> Column:
    """The first of the field's columns that is set, stripped; '' if none is."""
    have = [c for c in COLUMNS[field] if c in df.columns]
    return F.coalesce(*[present(F.col(f"`{c}`").cast("string")) for c in have], F.lit(""))


def normalize_truth(df: DataFrame) -> DataFrame:
    """Ground-truth or prediction rows in the seven normalized columns."""
    url = pick(df, "paper_url")
    found = lambda pattern, group: F.regexp_extract(url, pattern, group)
    first = lambda *cs: F.coalesce(*[F.nullif(c, F.lit("")) for c in cs], F.lit(""))
    pmc = F.upper(pick(df, "pmcid"))
    pmc = F.when((pmc != "") & ~F.startswith(pmc, F.lit("PMC")), F.concat(F.lit("PMC"), pmc)).otherwise(pmc)
    pmcid = first(pmc, F.upper(found(r"(?i)PMC\d{4,}", 0)))
    pmid = first(pick(df, "pmid"), found(r"(?i)/pubmed/(\d+)", 1))
    doi = first(normalize_doi(pick(df, "doi")), normalize_doi(found(r"(?i)doi\.org/(10\.\d{4,9}/[\w\.\-/:;()]+)", 1)))
    ident, repo = pick(df, "dataset_identifier"), pick(df, "repository")
    return df.select(
        first(pick(df, "paper_id"), pmcid, pmid, doi, url).alias("paper_id"), pmcid.alias("pmcid"), pmid.alias("pmid"), doi.alias("paper_doi"),
        F.when(is_na(ident), F.lit(NA)).otherwise(normalize_identifier(ident)).alias("dataset_identifier"),
        F.when(is_na(repo), F.lit(NA)).otherwise(first(normalize_repository(repo), repo)).alias("repository"), pick(df, "url").alias("url"),
    )


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Normalized ground truth with an identifier, and row_id in file order."""
    return normalize_truth(read_records(spark, path)).filter("dataset_identifier <> ''").withColumn("row_id", F.monotonically_increasing_id())


def url_lines(spark: SparkSession, path: str) -> DataFrame:
    """(url, row_id) of a list with one URL a line; blank lines and # comments are skipped."""
    lines = spark.read.text(path).select(strip("value").alias("url")).filter("url <> '' and not startswith(url, '#')")
    return lines.withColumn("row_id", F.monotonically_increasing_id())


def id_url_lines(spark: SparkSession, path: str) -> DataFrame:
    """(paper_id, url) of tab-separated lines; blank, # and malformed lines are skipped."""
    lines = spark.read.text(path).filter("trim(value) <> '' and not startswith(trim(value), '#')")
    parts = lines.select(F.split("value", "\t", 2).alias("p")).filter(F.size("p") == 2)
    return parts.select(strip(F.col("p")[0]).alias("paper_id"), strip(F.col("p")[1]).alias("url"))


def first_urls(rows: DataFrame, url: str = "url", order: str = "row_id") -> DataFrame:
    """(paper_id, url): the first URL of each paper, whose id is its PMCID or a slug."""
    pmc = F.nullif(F.upper(F.regexp_extract(url, r"(?i)PMC\d{4,}", 0)), F.lit(""))
    return rows.select(F.coalesce(pmc, slug(url)).alias("paper_id"), url, order).groupBy("paper_id").agg(F.min_by(url, order).alias("url"))


def collect_urls(spark: SparkSession, *lists: DataFrame, pmcids: DataFrame | None = None) -> DataFrame:
    """(url, rank): the union of URL lists and of PMC URLs of pmcids, first occurrences in order."""
    parts = [df.select("url", F.lit(i).alias("part"), "row_id") for i, df in enumerate(lists)]
    if pmcids is not None:
        own = pmcids.select(F.upper(present("pmcid")).alias("p")).filter("p is not null").distinct()
        parts.append(own.select(F.concat(F.lit("https://pmc.ncbi.nlm.nih.gov/articles/"), "p", F.lit("/")).alias("url"), F.lit(len(lists)).alias("part"), F.xxhash64("p").alias("row_id")))
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("url").agg(F.min(F.struct("part", "row_id")).alias("rank"))


def resolve_dois(urls: DataFrame, resolve: Callable[[list[str]], dict[str, str]], batch: int = 100) -> DataFrame:
    """(doi, pmcid) of distinct DOIs, looked up in batches by an injected client."""
    dois = urls.select(F.lower("doi").alias("doi")).filter("doi <> ''").distinct()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                asked = frame["doi"].tolist()[at : at + batch]
                known = resolve(asked)
                yield pd.DataFrame({"doi": asked, "pmcid": [known.get(d) for d in asked]})

    return dois.mapInPandas(run, "doi string, pmcid string")


def route_urls(urls: DataFrame, resolved: DataFrame) -> DataFrame:
    """URLs with kind (pmc, doi, other), pmcid where known, and route: xml or pdf."""
    doi = F.lower(F.nullif(F.regexp_extract("url", r"(?i)10\.\d{4,9}/[\w\.\-/:;()<>]+", 0), F.lit("")))
    made = urls.withColumn("kind", classify_url("url")).withColumn("doi", F.when(F.col("kind") == "doi", F.regexp_replace(doi, "/+$", "")))
    own = F.nullif(F.upper(F.regexp_extract("url", r"(?i)PMC\d{4,}", 0)), F.lit(""))
    met = made.join(resolved.select(F.lower("doi").alias("doi"), F.col("pmcid").alias("found")), "doi", "left").withColumn("pmcid", F.coalesce(own, "found")).drop("found")
    return met.withColumn("route", F.when(F.col("pmcid").isNotNull(), "xml").otherwise("pdf"))


def sample_truth(truth: DataFrame, link: str, n: int, seed: int = 42) -> DataFrame:
    """Truth rows of n distinct links, drawn by a hash: the same on any engine."""
    drawn = truth.select(link).distinct().orderBy(F.md5(F.concat(F.col(link), F.lit(str(seed)))), link).limit(n)
    return truth.join(drawn, link, "left_semi")


def fetch(urls: DataFrame, client: Callable[[str], str], tries: int = 5, at_once: int = 3) -> DataFrame:
    """(source_url, content, error) of URLs by an injected client that returns texts; paced and repeated as paced.fetch() says."""
    transport = lambda url: paced.Response(200, client(url))
    got = paced.fetch(urls.select("url", F.col("url").alias("asked")), transport, paced.Policy(tasks=at_once, tries=tries))
    return got.select(F.col("url").alias("source_url"), "content", "error")


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """row_id by an explicit order, for inputs too large to number in file order use a key instead."""
    return df.withColumn("row_id", F.row_number().over(W.orderBy(*order)).cast("long"))
