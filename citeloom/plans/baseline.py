"""A baseline tool over papers: every run ends with one status, told from its rows.

The tool is an injected factory that makes an extractor(url, paper) -> rows for
each task; rows are dicts with the tool's own column names. What becomes of each
paper is a row (OUTCOME), written before anything is counted, and the run's
status is one aggregate over them:

no_key            a key was asked for and isn't there; nothing was called
unavailable       the tool can't be made
no_urls           no paper has an address
all_urls_failed   every address failed
error             the run itself broke
no_predictions    it went through and found nothing
ok                it found something
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.identifiers import pick_url, present
from citeloom.operators.flatten import HEADER, ITEM, ITEMS, flatten_references
from citeloom.operators.metrics import IN_PRICE, OUT_PRICE, OUT_SHARE
from citeloom.session import reach_workers, stored

Tool = Callable[[str, str], list[dict[str, Any]]]
#: Column names that tools use, by field, in order, and words for nothing (fixed values).
NAMES = {"dataset_identifier": ("dataset_identifier", "dataset_id", "identifier", "id"), "repository": ("data_repository", "repository", "source"), "webpage": ("dataset_webpage",)}
NOTHING = ("", "nan", "none", "n/a")
OUTCOME = "paper_id string, paper_doi string, pmcid string, pmid string, url string, outcome string, error string, raw_rows int, input_chars long, dataset_references " + ITEMS


class Unavailable(RuntimeError):
    """The tool can't be made."""


def reference_of(row: dict[str, Any]) -> dict[str, str] | None:
    """A tool's row as a reference; None if it names no dataset."""
    text = lambda v: "" if v is None or str(v).strip().lower() in NOTHING else str(v)
    first = lambda field: next((t for n in NAMES[field] if (t := text(row.get(n)))), "")
    if not (identifier := first("dataset_identifier")):
        return None
    page = first("webpage")
    return {c: "" for c in ITEM} | {"dataset_identifier": identifier, "repository": first("repository"), "notes": f"webpage={page}" if page else ""}


def outcomes(papers: DataFrame, make_tool: Callable[[], Tool], text: str = "full_text") -> DataFrame:
    """OUTCOME rows of papers(HEADER, source_url, text): ok, empty, failed (with the reason) or no_url."""
    url = pick_url() if "source_url" in papers.columns else pick_url(F.lit(None).cast("string"))
    rows = papers.select(*HEADER, url.alias("url"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    item = pa.struct([(c, pa.string()) for c in ITEM])
    schema = pa.schema([*[(c, pa.string()) for c in (*HEADER, "url", "outcome", "error")], ("raw_rows", pa.int32()), ("input_chars", pa.int64()), ("dataset_references", pa.list_(item))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = None
        for batch in batches:
            tool = tool or make_tool()
            out = []
            for paper in batch.to_pylist():
                body = paper.pop("text")
                made: dict[str, Any] = paper | {"outcome": "no_url", "error": None, "raw_rows": 0, "input_chars": 0, "dataset_references": []}
                if paper["url"]:
                    try:
                        found = tool(paper["url"], body)
                    except Exception as e:  # noqa: BLE001 - told in the row
                        made |= {"outcome": "failed", "error": f"{type(e).__name__}: {e}"}
                    else:
                        kept = [r for r in map(reference_of, found) if r]
                        made |= {"outcome": "ok" if kept else "empty", "raw_rows": len(found), "input_chars": len(body), "dataset_references": kept}
                out.append(made)
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    reach_workers(papers.sparkSession)
    return rows.mapInArrow(run, OUTCOME)


def tokens_and_cost(input_tokens: Column, in_price: float, out_price: float) -> list[Column]:
    """Output tokens are a share of the input's, as everywhere."""
    out = F.floor(input_tokens * OUT_SHARE).cast("long")
    return [input_tokens.alias("input_tokens"), out.alias("output_tokens"), F.round(input_tokens / 1000 * in_price + out / 1000 * out_price, 6).alias("cost_usd")]


def run_status(rows: DataFrame, tokens_per_char: float = 0.25, in_price: float = IN_PRICE, out_price: float = OUT_PRICE) -> DataFrame:
    """One row: the status and counts of a run, of its OUTCOME rows."""
    of = lambda *kinds: F.count_if(F.col("outcome").isin(*kinds))
    counted = rows.agg(
        F.count("*").alias("n_papers"), of("ok", "empty", "failed").alias("n_urls"), of("failed").alias("n_failed"), F.coalesce(F.sum(F.size("dataset_references")), F.lit(0)).cast("long").alias("n_references"),
        F.coalesce(F.sum("raw_rows"), F.lit(0)).cast("long").alias("raw_rows"), F.floor(F.coalesce(F.sum("input_chars"), F.lit(0)) * tokens_per_char).cast("long").alias("tokens"), F.min(F.when(F.col("outcome") == "failed", F.col("error"))).alias("error"),
    )
    status = F.when(F.col("n_urls") == 0, "no_urls").when(F.col("n_failed") == F.col("n_urls"), "all_urls_failed").when(F.col("n_references") == 0, "no_predictions").otherwise("ok")
    return counted.select(status.alias("status"), "n_papers", "n_urls", "n_failed", "n_references", "raw_rows", "error", *tokens_and_cost(F.col("tokens"), in_price, out_price))


def run_baseline(papers: DataFrame, make_tool: Callable[[], Tool], text: str = "full_text", key: str | None = "", **prices: float) -> tuple[DataFrame, DataFrame, dict[str, Any]]:
    """(predictions, rejects, status) of a run.

    key: the tool's key; None if one is asked for and isn't there. rejects are
    the papers without an address and those that failed, with the reason. A run
    never raises for the tool's sake: what went wrong is in the status.
    """
    spark, began = papers.sparkSession, time.time()
    nothing = flatten_references(spark.createDataFrame([], OUTCOME)), spark.createDataFrame([], "paper_id string, url string, outcome string, error string")

    def ended(status: str, error: str | None) -> tuple[DataFrame, DataFrame, dict[str, Any]]:
        return *nothing, {"status": status, "error": error, "elapsed_sec": round(time.time() - began, 1), "n_predictions": 0}

    if key is None:
        return ended("no_key", "the tool asks for a key and none is given")
    try:
        make_tool()
    except Unavailable as e:
        return ended("unavailable", str(e))
    try:
        rows = stored(outcomes(papers, make_tool, text), "outcomes")
        status = run_status(rows, **prices).first().asDict()
        predictions = flatten_references(rows.filter("outcome in ('ok', 'empty')").select(*HEADER, "dataset_references"))
        found = predictions.filter(present("dataset_identifier").isNotNull() & (F.col("dataset_identifier") != "N/A"))
        status |= {"n_predictions": found.count(), "elapsed_sec": round(time.time() - began, 1)}
    except Exception as e:  # noqa: BLE001 - the run's end is a status
        return ended("error", f"{type(e).__name__}: {str(e)[:500]}")
    return predictions, rows.filter("outcome in ('no_url', 'failed')").select("paper_id", "url", "outcome", "error"), status
