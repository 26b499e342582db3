"""Extraction: an injected extractor over passages, and a deterministic one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.identifiers import present
from citeloom.functions.registry import ACCESSION
from citeloom.operators.flatten import HEADER, ITEM, ITEMS

Extractor = Callable[[str, str], list[dict]]
SCHEMA = "paper_id string, paper_doi string, pmcid string, pmid string, dataset_references " + ITEMS


def pattern_references(text: str | Column) -> Column:
    """References by accession pattern, each once, with surrounding text as evidence."""
    c = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(ACCESSION), F.lit(0)))

    def item(token: Column) -> Column:
        at = F.locate(token, c) if isinstance(token, str) else F.instr(c, token)
        evidence = F.substr(c, F.greatest(F.lit(1), at - 80), F.lit(200))
        return F.struct(token.alias("dataset_identifier"), F.lit("").alias("repository"), evidence.alias("evidence"), F.lit("high").alias("confidence"), F.lit("pattern").alias("notes"))

    return F.transform(found, item)


def extract_by_pattern(papers: DataFrame, text: str = "candidate_passages") -> DataFrame:
    """The offline default: no Python, no shuffle."""
    return papers.select(*HEADER, pattern_references(text).alias("dataset_references"))


def extract(papers: DataFrame, extractor: Extractor, text: str = "candidate_passages", parallelism: int | None = None) -> DataFrame:
    """Call extractor(prompt text, paper_id) for each paper, in batches.

    The extractor returns dicts with the item fields; missing ones are "".
    parallelism bounds how many tasks call it at once. Its results should be
    written before they are used twice: it may be costly and not repeatable.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            refs = [[{k: str(item.get(k, "") or "") for k in ITEM} for item in extractor(t or "", p or "")] for t, p in zip(frame[text], frame["paper_id"], strict=True)]
            yield frame[list(HEADER)].assign(dataset_references=refs)

    rows = papers.select(*dict.fromkeys([*HEADER, text]))
    if parallelism:
        rows = rows.repartition(parallelism)
    return rows.mapInPandas(run, SCHEMA)


def extract_with_status(papers: DataFrame, extractor: Extractor, text: str = "full_text") -> DataFrame:
    """(header, dataset_references, status): ok, no_predictions, or error with the message."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            refs, status = [], []
            for t, p in zip(frame[text], frame["paper_id"], strict=True):
                try:
                    got = [{k: str(item.get(k, "") or "") for k in ITEM} for item in extractor(t or "", p or "")]
                    refs.append(got)
                    status.append("ok" if got else "no_predictions")
                except Exception as e:  # noqa: BLE001 - a failed paper is a row, not a failed job
                    refs.append([])
                    status.append(f"error: {e}")
            yield frame[list(HEADER)].assign(dataset_references=refs, status=status)

    return papers.select(*dict.fromkeys([*HEADER, text])).mapInPandas(run, SCHEMA + ", status string")


def attach_references(papers: DataFrame, references: DataFrame, on: str = "source_url") -> DataFrame:
    """Every paper with its list of references (by URL), an empty one if it has none."""
    item = F.struct(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ITEM])
    lists = references.filter(~F.lower(F.coalesce(present("dataset_identifier"), F.lit(""))).isin("", "nan", "none", "n/a")).groupBy(on).agg(F.collect_list(item).alias("dataset_references"))
    return papers.join(lists, on, "left").withColumn("dataset_references", F.coalesce("dataset_references", F.array().cast(ITEMS)))
