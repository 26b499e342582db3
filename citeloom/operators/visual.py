"""Predictions and ground truth side by side, as HTML pages that tasks write.

Both sides of a paper stand next to each other, row by row, with their status;
a prediction names the truth row that it picked. A page holds one model's papers
of one range. Rows of a paper are cut into blocks of at most BLOCK numbers of
row_id, so no task holds more than a block whatever a paper has.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions.identifiers import present
from citeloom.operators import match
from citeloom.session import reach_workers
from citeloom.sources.sinks import write_text

BLOCK_BITS = 8
STATUSES = {"TP": "#cfc", "REPO-MISMATCH": "#ffc", "FP": "#fcc", "FN": "#fcc"}
STYLE = "<style>body{font-family:sans-serif}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:2px 6px}.pair{display:flex;gap:1em}" + "".join(f".{s.lower()}{{background:{c}}}" for s, c in STATUSES.items()) + "</style>"
ROW = "paper string, side string, row_id long, label string, identifier string, repository string, url string, status string, picked long"


def visual_rows(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """(ROW) of all rows that name a dataset: what the inputs say of them, their status, and the truth row a prediction picked."""
    text = lambda c: lambda df: F.coalesce(F.col(c), F.lit("")) if c in df.columns else F.lit("")
    label = lambda df: F.coalesce(present("paper_id"), present("pmcid"), F.lit(""))
    # What is shown goes along with the rows, so nothing is joined back.
    rows = match.resolved_rows(predictions, truth, {"label": label, "identifier": text("dataset_identifier"), "repository": text("repository"), "url": text("url")})
    return match.judged(rows).select("paper", "side", F.col("row_id").cast("long").alias("row_id"), "label", "identifier", "repository", "url", "status", F.col("picked").cast("long").alias("picked"))


def escaped(c: Column) -> Column:
    return reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")), c)


def row_html() -> Column:
    url = escaped(F.col("url"))
    link = F.when(F.col("url").rlike(r"(?i)^https?://"), F.concat(F.lit('<a href="'), url, F.lit('">'), url, F.lit("</a>"))).otherwise(url)
    cells = [F.col("row_id").cast("string"), escaped(F.col("identifier")), escaped(F.col("repository")), link, F.concat(F.col("status"), F.coalesce(F.concat(F.lit(" of "), F.col("picked").cast("string")), F.lit("")))]
    return F.concat(F.lit('<tr class="'), F.lower("status"), F.lit('"><td>'), F.array_join(F.array(*cells), "</td><td>"), F.lit("</td></tr>"))


def visual_blocks(rows: DataFrame) -> DataFrame:
    """(paper, part, html, and the number of each status) of visual_rows(): a paper's rows side by side, in blocks."""
    cells = rows.select("paper", F.shiftright("row_id", BLOCK_BITS).alias("part"), "side", "row_id", "label", "status", row_html().alias("html"))
    of = lambda side: F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("row_id", "html"))))
    tallies = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    made = cells.groupBy("paper", "part").agg(F.min(F.nullif("label", F.lit(""))).alias("label"), of(match.PREDICTION).alias("p"), of(match.TRUTH).alias("t"), *tallies)
    head = "<tr><th>#</th><th>ID</th><th>Repository</th><th>URL</th><th>Status</th></tr>"

    def half(title: str, c: str) -> Column:
        table = F.concat(F.lit(f"<table>{head}"), F.array_join(F.transform(c, lambda x: x["html"]), ""), F.lit("</table>"))
        return F.concat(F.lit(f"<div><h3>{title}</h3>"), F.when(F.size(c) > 0, table).otherwise("(none)"), F.lit("</div>"))

    title = F.format_string("<h4>Paper: %s (%d predicted, %d in the truth)</h4>", escaped(F.coalesce("label", "paper")), F.size("p"), F.size("t"))
    html = F.concat(title, F.lit('<div class="pair">'), half("Predictions", "p"), half("Ground truth", "t"), F.lit("</div>"))
    return made.select("paper", "part", html.alias("html"), *[f"`{s}`" for s in STATUSES])


def write_visual(spark: SparkSession, blocks: DataFrame, folder: str, pages: int = 16) -> list[str]:
    """Write pages of blocks(benchmark, model, method, paper, part, html) below a folder; returns their paths.

    Pages lie in benchmark=.../model=...; each is a whole document, of one range
    of papers. An index page lists them. Only their names come to the driver.
    """
    keys = ["benchmark", "model", "method"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, page = None, None
        for batch in batches:
            out = []
            for row in zip(*[batch.column(c).to_pylist() for c in (*keys, "html")], strict=True):
                now, block = row[:3], row[3]
                if now[:2] != page:
                    if page is not None:
                        out.append((*page, "</body></html>"))
                    page = now[:2]
                    out.append((*page, f"<!doctype html><html><head><meta charset='utf-8'>{STYLE}</head><body>"))
                if now != last:
                    last = now
                    out.append((*page, "<h2>" + " ".join(clean(x) for x in now) + "</h2>"))
                out.append((*page, block))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], ["benchmark", "model", "value"])
        if page is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.string()) for v in (*page, "</body></html>")], ["benchmark", "model", "value"])

    def clean(x: str | None) -> str:
        return (x or "").replace("&", "&amp;").replace("<", "&lt;")

    reach_workers(spark)
    order = [*keys, "paper", "part"]
    # One line a block: texts with line ends would be cut by the writer.
    lines = blocks.select(*order, F.regexp_replace("html", r"[\r\n]+", " ").alias("html")).repartitionByRange(pages, *order).sortWithinPartitions(*order)
    lines.mapInArrow(run, "benchmark string, model string, value string").write.mode("overwrite").partitionBy("benchmark", "model").text(folder)
    return _name_pages(spark, folder)


def _name_pages(spark: SparkSession, folder: str) -> list[str]:
    """Give the written files the ending of pages, and list them in an index."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files, out = fs.listFiles(path(folder), True), []
    while files.hasNext():
        at = files.next().getPath()
        if at.getName().startswith("part-"):
            named = path(at.getParent(), at.getName().rsplit(".", 1)[0][:10] + ".html")
            fs.rename(at, named)
            out.append("/".join([named.getParent().getParent().getName(), named.getParent().getName(), named.getName()]))
    listed = "".join(f'<li><a href="{p}">{p}</a></li>' for p in sorted(out))
    write_text(spark, f"<!doctype html><html><body><ul>{listed}</ul></body></html>\n", f"{folder}/index.html")
    return sorted(out)
