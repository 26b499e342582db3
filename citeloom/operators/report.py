"""Reports over run metrics: matrices, details, costs, comparisons, Markdown."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeloom.functions.identifiers import display_model, metrics_file

METRICS = ("precision", "recall", "f1")


def best_in_group(metrics: DataFrame) -> DataFrame:
    """metrics(benchmark, model, method, metric, value) with best: ties are all best."""
    top = F.max("value").over(W.partitionBy("benchmark", "model", "metric"))
    return metrics.withColumn("best", F.coalesce(F.col("value") == top, F.lit(False)))


def matrix(metrics: DataFrame, names=METRICS) -> DataFrame:
    """One row for each benchmark, model and method, a column for each metric."""
    return metrics.groupBy("benchmark", "model", "method").pivot("metric", list(names)).agg(F.max("value"))


def detail(metrics: DataFrame, names=METRICS) -> DataFrame:
    """Pair and triple scores side by side for each run."""
    named = metrics.withColumn("column", F.concat_ws("_", "scope", "metric"))
    return named.groupBy("benchmark", "model", "method").pivot("column", [f"{s}_{m}" for s in ("pair", "triple") for m in names]).agg(F.max("value"))


def top_failures(failures: DataFrame, k: int = 5) -> DataFrame:
    """The first k failures of each bucket in key order."""
    n = F.row_number().over(W.partitionBy("bucket").orderBy("paper", "ds"))
    return failures.withColumn("n", n).filter(F.col("n") <= k)


def cost_rows(summaries: DataFrame) -> DataFrame:
    """(benchmark, model, method, tokens, cost): a reported cost goes before an estimate."""
    return summaries.select("benchmark", "model", "method", (F.col("approx_input_tokens") + F.col("approx_output_tokens")).alias("tokens"), F.coalesce(F.nullif("reported_cost_usd", F.lit(0.0)), "approx_cost_usd").alias("cost_usd"))


def cost_table(summaries: DataFrame, methods: tuple[str, ...]) -> DataFrame:
    """Costs of one column for each method as rows (unpivoted), nulls left out."""
    return summaries.unpivot(["benchmark", "model"], list(methods), "method", "cost_usd").filter("cost_usd is not null")


def compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two one-row metric frames side by side and who has the better F1."""
    a, b = left.select([F.col(c).alias(f"left_{c}") for c in METRICS]), right.select([F.col(c).alias(f"right_{c}") for c in METRICS])
    delta = F.round(F.col("left_f1") - F.col("right_f1"), 4)
    return a.crossJoin(b).withColumn("delta_f1", delta).withColumn("better", F.when(delta > 0, "left").when(delta < 0, "right").otherwise("tie"))


def run_grid(benchmarks: DataFrame, models: DataFrame, methods: DataFrame) -> DataFrame:
    """Every run to make; the three inputs are configuration lists."""
    return benchmarks.crossJoin(models).crossJoin(methods)


def markdown_table(df: DataFrame, bold: dict[str, str] | None = None) -> str:
    """A small frame as a Markdown table; bold maps a column to its flag column."""
    shown = [c for c in df.columns if c not in set((bold or {}).values())]
    lines = ["| " + " | ".join(shown) + " |", "|" + "---|" * len(shown)]
    for row in df.collect():
        cells = ["" if row[c] is None else f"{row[c]:.4f}" if isinstance(row[c], float) else str(row[c]) for c in shown]
        lines.append("| " + " | ".join(f"**{v}**" if bold and c in bold and row[bold[c]] else v for c, v in zip(shown, cells, strict=True)) + " |")
    return "\n".join(lines)


# -- the report over metrics files ---------------------------------------------

#: Orders and names in reports (fixed values).
BENCHMARKS, METHODS = ("exp", "rev"), ("rtr", "fdr", "datagatherer_rtr", "datagatherer_fdr")
SCOPES = (("pair_micro", "Pair"), ("triple_micro", "Triple"))
_SCORES = "struct<precision:double,recall:double,f1:double,tp:bigint,fp:bigint,fn:bigint,n_papers:bigint>"
_EXAMPLES = "struct<n:bigint,examples:array<array<string>>>"
METRICS_FILE = (
    f"label string, model string, benchmark string, pair_micro {_SCORES}, pair_macro {_SCORES}, triple_micro {_SCORES}, triple_macro {_SCORES}, "
    "coverage struct<papers_with_predictions:bigint,papers_in_groundtruth:bigint,empty_papers:bigint,total_predictions:bigint,na_predictions:bigint,total_groundtruth:bigint>, "
    f"failures struct<missed:{_EXAMPLES},hallucinated:{_EXAMPLES},incomplete:{_EXAMPLES}>"
)


def position(c: Column, order: tuple[str, ...]) -> Column:
    """Where a value stands in a custom order; values not in it come after all others."""
    return F.coalesce(F.nullif(F.array_position(F.lit(list(order)), c), F.lit(0)), F.lit(99))


def load_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each metrics file (JSON) of a folder, as METRICS_FILE says.

    What a file lacks of benchmark, model and label comes from its name. Files
    that are no JSON objects of metrics are left out.
    """
    raw = spark.read.schema(METRICS_FILE + ", _broken string").option("multiLine", True).option("columnNameOfCorruptRecord", "_broken").option("pathGlobFilter", "*.json").json(folder)
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1)
    named = raw.select("*", metrics_file(stem).alias("of")).filter("_broken is null and pair_micro is not null")
    first = lambda c, d: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"of.{d}"), F.lit("")).alias(c)
    rest = [c for c in raw.columns if c not in ("label", "model", "benchmark", "_broken")]
    return named.select(first("benchmark", "benchmark"), first("model", "model"), first("label", "method"), *rest)


def six_scores(loaded: DataFrame) -> DataFrame:
    """(benchmark, model, label, scope, metric, value, best): best of its benchmark and model, ties all best."""
    scores = [F.struct(F.lit(s).alias("scope"), F.lit(m).alias("metric"), F.col(f"{s}.{m}").alias("value")) for s, _ in SCOPES for m in METRICS]
    each = loaded.select("benchmark", "model", "label", F.explode(F.array(*scores)).alias("e")).select("benchmark", "model", "label", "e.*")
    top = F.max("value").over(W.partitionBy("benchmark", "model", "scope", "metric"))
    return each.withColumn("best", F.coalesce(F.col("value") == top, F.lit(False)))


def report_order(loaded: DataFrame) -> DataFrame:
    """Rows by benchmark, model and method, benchmarks and methods in their own order."""
    return loaded.orderBy(position(F.col("benchmark"), BENCHMARKS), "benchmark", "model", position(F.col("label"), METHODS), "label")


def shown(value: Any, places: int = 4) -> str:
    """A cell: fixed places for fractions, a dash for nothing."""
    return "-" if value is None else f"{value:.{places}f}" if isinstance(value, float) else str(value)


#: What a run's details list, by part of its record (fixed values).
COUNTS = ("tp", "fp", "fn")
DETAILS = {
    "pair_micro": (*METRICS, *COUNTS), "triple_micro": (*METRICS, *COUNTS), "pair_macro": (*METRICS, "n_papers"), "triple_macro": (*METRICS, "n_papers"),
    "coverage": ("papers_with_predictions", "papers_in_groundtruth", "empty_papers", "total_predictions", "na_predictions", "total_groundtruth"),
}
BUCKETS = ("missed", "hallucinated", "incomplete")


def detail_rows(loaded: DataFrame) -> DataFrame:
    """(benchmark, model, label, pos, part, item, value): a record's numbers and first failures as one long frame; what it lacks has no row."""
    text = lambda c, kind: F.when(c.isNotNull(), F.format_string("%.4f", c) if kind == "double" else c.cast("string"))
    items = [(part, name, text(F.col(f"{part}.{name}"), "double" if name in METRICS else "bigint")) for part, names in DETAILS.items() for name in names]
    items += [("failures", b, F.nullif(F.col(f"failures.{b}.n").cast("string"), F.lit("0"))) for b in BUCKETS]
    items += [(f"first {b}", str(k + 1), F.array_join(F.try_element_at(F.col(f"failures.{b}.examples"), F.lit(k + 1)), ", ")) for b in BUCKETS for k in range(5)]
    rows = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(part).alias("part"), F.lit(item).alias("item"), value.alias("value")) for i, (part, item, value) in enumerate(items)])
    return loaded.select("benchmark", "model", "label", F.explode(rows).alias("r")).select("benchmark", "model", "label", "r.*").filter("value is not null")


def generate_report(loaded: DataFrame, summaries: DataFrame | None = None) -> str:
    """The Markdown report over runs: comparison, details, costs.

    loaded: load_metrics(); summaries: (benchmark, model, method, elapsed_sec,
    tokens, cost_usd). Both have a row for each run.
    """
    best = {(r["benchmark"], r["model"], r["label"], r["scope"], r["metric"]): r["best"] for r in six_scores(loaded).collect()}
    runs = report_order(loaded.withColumn("shown_model", display_model("model"))).collect()
    out = ["# Dataset references: results", "", "## Comparison", "", "Bold: the best of a benchmark and model.", ""]
    out += ["| Benchmark | Model | Method | " + " | ".join(f"{title} {m}" for _, title in SCOPES for m in METRICS) + " |", "|" + "---|" * (3 + len(SCOPES) * len(METRICS))]
    for r in runs:
        cells = [r["benchmark"].upper(), r["shown_model"], r["label"]]
        for scope, _ in SCOPES:
            for m in METRICS:
                text = shown(r[scope][m] if r[scope] else None)
                cells.append(f"**{text}**" if best.get((r["benchmark"], r["model"], r["label"], scope, m)) else text)
        out.append("| " + " | ".join(cells) + " |")
    own: dict[tuple, list] = {}
    for r in detail_rows(loaded).orderBy("pos").collect():
        own.setdefault((r["benchmark"], r["model"], r["label"]), []).append(f"| {r['part']} | {r['item']} | {r['value']} |")
    out += ["", "## Details", ""]
    for r in runs:
        listed = own.get((r["benchmark"], r["model"], r["label"]), [])
        out += [f"### {r['benchmark'].upper()}, {r['shown_model']}, {r['label']}", "", "| Part | Item | Value |", "|---|---|---|", *listed, ""]
    if summaries is not None and (costs := report_order(summaries.withColumn("label", F.col("method")).withColumn("shown_model", display_model("model"))).collect()):
        out += ["## Cost and time", "", "| Benchmark | Model | Method | Time (s) | Input tokens | Cost (USD) |", "|---|---|---|---|---|---|"]
        for r in costs:
            tokens = "-" if r["tokens"] is None else f"{int(r['tokens']):,}"
            out.append(f"| {r['benchmark'].upper()} | {r['shown_model']} | {r['method']} | {shown(r['elapsed_sec'], 1)} | {tokens} | {shown(r['cost_usd'])} |")
    return "\n".join(out) + "\n"


def aligned(rows: list[tuple[str, ...]]) -> str:
    """Rows as text in columns, a rule below the first."""
    widths = [max(map(len, column)) for column in zip(*rows, strict=True)]
    lines = ["  ".join(cell.ljust(w) for cell, w in zip(row, widths, strict=True)).rstrip() for row in rows]
    return "\n".join([lines[0], "  ".join("-" * w for w in widths), *lines[1:]])


def cost_text(summaries: list[dict[str, Any]]) -> str:
    """Time, tokens and cost of each run, for a console: what was counted or reported goes before what was estimated."""
    first = lambda cost, *names: next((str(cost[n]) for n in names if cost.get(n)), "-")
    rows = [("Benchmark", "Model", "Method", "Time(s)", "Input tokens", "Cost($)")]
    for s in summaries:
        cost = s.get("cost") or {}
        rows.append((*(str(s.get(k) or "-") for k in ("benchmark", "model", "method", "elapsed_sec")), first(cost, "input_tokens_total", "input_tokens", "approx_input_tokens"), first(cost, "reported_cost_usd", "cost_usd", "approx_cost_usd")))
    return aligned(rows) if len(rows) > 1 else ""
