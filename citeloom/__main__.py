"""Command line: python -m citeloom prepare | fetch | predict | evaluate | compare | report | costs | visualize | repeats | run.

--pdf-reader and --transport name callables as module:name: a reader takes a
PDF's bytes and returns its pages' texts, a transport takes a URL and returns a
sources.fetch.Response. Without a reader a folder that holds PDF files is an
error, unless --skip-pdf leaves them out by name.
"""

from __future__ import annotations

import argparse
import importlib
import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions.identifiers import safe_model
from citeloom.operators import candidates, match, metrics, repeats, report, sections, visual
from citeloom.plans.pipeline import full_text_pipeline, metrics_record, passages_pipeline
from citeloom.session import exists
from citeloom.sources import fetch, readers, sinks

STRATEGIES = {"rtr": passages_pipeline, "fdr": full_text_pipeline}


def load_papers(spark: SparkSession, path: str) -> DataFrame:
    """Papers written by prepare."""
    return spark.read.parquet(path)


def load_truth(spark: SparkSession, path: str) -> DataFrame:
    return readers.read_truth(spark, path)


def load_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Normalized predictions, with row_id, of a file or a folder of JSON lines."""
    rows = spark.read.option("primitivesAsString", True).json(path)
    return readers.normalize_truth(rows).withColumn("row_id", F.monotonically_increasing_id())


def named(target: str | None) -> Callable | None:
    """The callable that module:name says."""
    if not target:
        return None
    module, _, name = target.partition(":")
    return getattr(importlib.import_module(module), name)


def prepare(spark: SparkSession, folder: str, out: str, read_pages: Callable[[bytes], list[str]] | None = None, skip_pdf: bool = False) -> DataFrame:
    """Papers of a folder with their candidate passages, written as Parquet.

    PDF files need a reader; without one they are an error that says how many
    there are, or, with skip_pdf, left out and counted on the console.
    """
    files = readers.paper_files(spark, folder)
    pdf = F.lower("source_path").endswith(".pdf")
    if read_pages is None and (n := files.filter(pdf).count()):
        if not skip_pdf:
            raise ValueError(f"{n} PDF files in {folder} and no reader of PDF pages (--pdf-reader module:name, or --skip-pdf to leave them out)")
        print(f"{n} PDF files left out")
        files = files.filter(~pdf)
    sinks.write_papers(candidates.select_passages(sections.parse_files(files, read_pages)), out)
    return load_papers(spark, out)


def fetch_papers(spark: SparkSession, urls: str, out: str, transport: fetch.Transport, cache: str | None = None, policy: fetch.Policy | None = None) -> dict:
    """Papers of a list of URLs, written as Parquet, and what failed, as JSON lines beside them; the cache is kept for reruns."""
    got = fetch.Cache(spark, cache or f"{out}.cache").get(readers.url_lines(spark, urls).select("url"), transport, policy)
    sinks.write_papers(fetch.papers_of(got), out)
    failed = got.filter("content is null").select("url", "error", "calls")
    sinks.write_json_lines(failed, f"{out}.failed")
    return {"papers": load_papers(spark, out).count(), "failed": failed.count()}


def predict(spark: SparkSession, papers: str, out: str, strategy: str) -> dict:
    """Predictions of the offline extractor as JSON lines; returns the run's summary."""
    began, held = time.time(), load_papers(spark, papers)
    sinks.write_json_lines(STRATEGIES[strategy]().run(held), out)
    cost = {r["strategy"]: r.asDict() for r in metrics.token_estimate(held).collect()}.get(strategy, {})
    return {"method": strategy, "n_papers": held.count(), "n_predictions": spark.read.json(out).count(), "elapsed_sec": round(time.time() - began, 2), "cost": {k: v for k, v in cost.items() if k != "strategy"}}


def evaluate(spark: SparkSession, predictions: str, truth: str, out: str, **names: str) -> dict:
    record = metrics_record(load_predictions(spark, predictions), load_truth(spark, truth), **names)
    sinks.write_record(spark, record, out)
    return record


def compare(spark: SparkSession, left: str, right: str) -> str:
    """Two metrics files side by side."""
    one, two = (report.load_metrics(spark, p).first() for p in (left, right))
    lines = [f"{'metric':<28}{'left':>12}{'right':>12}"]
    for scope in ("pair_micro", "pair_macro", "triple_micro"):
        names = report.METRICS if scope == "pair_macro" else (*report.METRICS, "tp", "fp", "fn")
        lines += [f"{scope + '.' + m:<28}{report.shown(one[scope][m]):>12}{report.shown(two[scope][m]):>12}" for m in names]
    for bucket in ("missed", "hallucinated", "incomplete"):
        n = [r["failures"][bucket]["n"] if r["failures"] and r["failures"][bucket] else 0 for r in (one, two)]
        lines.append(f"{'failures.' + bucket:<28}{n[0]:>12}{n[1]:>12}")
    delta = one["pair_micro"]["f1"] - two["pair_micro"]["f1"]
    return "\n".join([*lines, "tie on pair F1" if delta == 0 else f"{'left' if delta > 0 else 'right'} has the higher pair F1, by {abs(delta):.4f}"])


def write_report(spark: SparkSession, folder: str, out: str, summaries: list[dict] | None = None) -> str:
    rows = [(s["benchmark"], s["model"], s["method"], s["elapsed_sec"], (s.get("cost") or {}).get("input_tokens"), (s.get("cost") or {}).get("cost_usd")) for s in summaries or []]
    frame = spark.createDataFrame(rows, "benchmark string, model string, method string, elapsed_sec double, tokens double, cost_usd double") if rows else None
    text = report.generate_report(report.load_metrics(spark, folder), frame)
    sinks.write_text(spark, text, out)
    return text


def load_runs(spark: SparkSession, path: str) -> list[dict]:
    """The run summaries that run() wrote."""
    text = spark.read.text(path, wholetext=True).first()["value"]
    return json.loads(text).get("runs", [])


def visualize(spark: SparkSession, predictions: str, truth: str, out: str, benchmark: str = "exp", model: str = "", method: str = "") -> list[str]:
    """Pages of both sides of one run."""
    rows = visual.visual_rows(load_predictions(spark, predictions), load_truth(spark, truth))
    blocks = visual.visual_blocks(rows).withColumns({"benchmark": F.lit(benchmark), "model": F.lit(safe_name(spark, model) or "model"), "method": F.lit(method)})
    return visual.write_visual(spark, blocks, out)


def repeat(spark: SparkSession, metrics_folder: str, log: str, run_number: int, out: str) -> str:
    """Add the metrics files of a folder to the run log as one run, and sum the log up: a table, and a JSON file."""
    repeats.append_runs(repeats.run_scores(report.load_metrics(spark, metrics_folder), run_number), log)
    runs = repeats.read_runs(spark, log)
    summary = repeats.repeat_summary(runs)
    sinks.write_record(spark, repeats.payload(summary, runs.select("run").distinct().count()), out)
    return repeats.console_table(summary)


def safe_name(spark: SparkSession, model: str) -> str:
    return spark.range(1).select(safe_model(F.lit(model))).first()[0]


def run(
    spark: SparkSession, raw: str, truth: str, out: str, benchmark: str = "exp", model: str = "offline", strategies: tuple[str, ...] = tuple(STRATEGIES), read_pages: Callable[[bytes], list[str]] | None = None, skip_pdf: bool = False,
    skip: tuple[str, ...] = (), urls: str | None = None, transport: fetch.Transport | None = None,
) -> str:
    """From papers and a truth file to metrics, statuses, pages and the report, below out.

    Papers come from the folder raw, or from a list of urls by a transport.
    model may name several, with commas. skip names steps to leave out
    (prepare, predict, evaluate, status, visualize, report); a step that is
    left out must have its results there already, or no step that needs them.
    """
    if "prepare" not in skip:
        if urls:
            if transport is None:
                raise ValueError("a list of URLs needs a transport (--transport module:name)")
            fetch_papers(spark, urls, f"{out}/papers", transport, f"{out}/cache")
        else:
            prepare(spark, raw, f"{out}/papers", read_pages, skip_pdf)
    summaries = []
    for name in filter(None, model.split(",")):
        safe = safe_name(spark, name)
        for strategy in strategies:
            at = f"{benchmark}_{safe}_{strategy}"
            predictions = f"{out}/predictions/{at}"
            if "predict" not in skip:
                summaries.append(predict(spark, f"{out}/papers", predictions, strategy) | {"benchmark": benchmark, "model": name})
            elif not exists(spark, predictions):
                raise ValueError(f"predict is skipped and {predictions} isn't there")
            if "evaluate" not in skip:
                evaluate(spark, predictions, truth, f"{out}/metrics/{at}.json", label=strategy, model=name, benchmark=benchmark)
            if "status" not in skip:
                rows = match.judged(match.resolved_rows(load_predictions(spark, predictions), load_truth(spark, truth)))
                for side, folder in ((match.PREDICTION, "predictions"), (match.TRUTH, "truth")):
                    rows.filter(F.col("side") == side).select("row_id", "paper", "ds", "status").write.mode("overwrite").parquet(f"{out}/status/{at}/{folder}")
            if "visualize" not in skip:
                visualize(spark, predictions, truth, f"{out}/visual/{at}", benchmark, name, strategy)
    if summaries:
        sinks.write_record(spark, {"runs": summaries}, f"{out}/runs.json")
    return "" if "report" in skip else write_report(spark, f"{out}/metrics", f"{out}/report.md", summaries)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="citeloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *options: str, **optional: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for o in options:
            c.add_argument(f"--{o}", required=True)
        for o, default in optional.items():
            c.add_argument(f"--{o}", default=default)
        return c

    command("prepare", "input", "output", **{"pdf-reader": ""}).add_argument("--skip-pdf", action="store_true")
    command("fetch", "urls", "output", "transport", cache="", rate="3")
    command("predict", "input", "output", strategy="rtr")
    command("evaluate", "predictions", "groundtruth", "output", label="", model="", benchmark="")
    command("compare", "left", "right")
    command("report", "metrics", "output")
    command("costs", "runs")
    command("visualize", "predictions", "groundtruth", "output", benchmark="exp", model="", method="")
    command("repeats", "metrics", "log", "run", "output")
    command("run", "groundtruth", "output", input="", urls="", transport="", benchmark="exp", model="offline", strategies="rtr,fdr", skip="", **{"pdf-reader": ""}).add_argument("--skip-pdf", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("citeloom").getOrCreate()
    if a.command == "prepare":
        print(f"{prepare(spark, a.input, a.output, named(a.pdf_reader), a.skip_pdf).count()} papers")
    elif a.command == "fetch":
        print(fetch_papers(spark, a.urls, a.output, named(a.transport), a.cache or None, fetch.Policy(rate=float(a.rate))))
    elif a.command == "predict":
        print(predict(spark, a.input, a.output, a.strategy))
    elif a.command == "evaluate":
        print(evaluate(spark, a.predictions, a.groundtruth, a.output, label=a.label, model=a.model, benchmark=a.benchmark)["pair_micro"])
    elif a.command == "compare":
        print(compare(spark, a.left, a.right))
    elif a.command == "report":
        print(write_report(spark, a.metrics, a.output))
    elif a.command == "costs":
        print(report.cost_text(load_runs(spark, a.runs)))
    elif a.command == "visualize":
        print("\n".join(visualize(spark, a.predictions, a.groundtruth, a.output, a.benchmark, a.model, a.method)))
    elif a.command == "repeats":
        print(repeat(spark, a.metrics, a.log, int(a.run), a.output))
    else:
        words = lambda x: tuple(filter(None, x.split(",")))
        print(run(spark, a.input, a.groundtruth, a.output, a.benchmark, a.model, words(a.strategies), named(a.pdf_reader), a.skip_pdf, words(a.skip), a.urls or None, named(a.transport)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
