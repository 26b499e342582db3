"""Repeated runs: a log that takes each run once, and means, deviations and values over it.

The log is a table partitioned by run. Appending a run replaces what an earlier
attempt of the same run left, so a repeated or resumed append changes nothing
else and counts nothing twice; of several attempts in one append the last holds.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEYS = ["benchmark", "model", "method"]
LOG = "benchmark string, model string, method string, run int, attempt int, metric string, value double"
#: The metrics of a run that are repeated, and where a metrics record has them (fixed values).
METRICS = {
    "pair_precision": "pair_micro.precision", "pair_recall": "pair_micro.recall", "pair_f1": "pair_micro.f1",
    "triple_precision": "triple_micro.precision", "triple_recall": "triple_micro.recall", "triple_f1": "triple_micro.f1",
    "macro_pair_f1": "pair_macro.f1", "macro_triple_f1": "triple_macro.f1",
}
NAN = float("nan")


def run_scores(loaded: DataFrame, run: int | Column, attempt: int | Column = 1) -> DataFrame:
    """LOG rows of metrics records (benchmark, model, label, pair_micro, ...); what a record lacks is NaN."""
    column = lambda c: F.lit(c) if isinstance(c, int) else c
    scores = [F.struct(F.lit(name).alias("metric"), F.coalesce(F.col(at).cast("double"), F.lit(NAN)).alias("value")) for name, at in METRICS.items()]
    each = loaded.select("benchmark", "model", F.col("label").alias("method"), column(run).cast("int").alias("run"), column(attempt).cast("int").alias("attempt"), F.explode(F.array(*scores)).alias("s"))
    return each.select(*KEYS, "run", "attempt", "s.metric", "s.value")


def last_attempts(log: DataFrame) -> DataFrame:
    """The rows of each run's last attempt; of rows that repeat in it one."""
    last = log.withColumn("last", F.max("attempt").over(W.partitionBy(*KEYS, "run"))).filter("attempt <=> last")
    return last.groupBy(*KEYS, "run", "attempt", "metric").agg(F.max("value").alias("value"))


def append_runs(log: DataFrame, folder: str) -> None:
    """Add runs (LOG) to the log below a folder that all executors share; a run that is there is replaced."""
    rows = last_attempts(log).repartition(*KEYS, "run")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS, "run").parquet(folder)


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(LOG).parquet(folder)


def repeat_summary(log: DataFrame) -> DataFrame:
    """(benchmark, model, method, metric, n_runs, mean, std, values): over each run's last attempt.

    NaN is left out of mean and sample deviation, which are NaN for want of one
    value or of two; values has all, in the order of the runs.
    """
    finite = F.nanvl(F.col("value"), F.lit(None).cast("double"))
    grouped = last_attempts(log).groupBy(*KEYS, "metric").agg(
        F.count("*").alias("n_runs"), F.coalesce(F.avg(finite), F.lit(NAN)).alias("mean"), F.coalesce(F.stddev_samp(finite), F.lit(NAN)).alias("std"),
        F.transform(F.array_sort(F.collect_list(F.struct("run", "value"))), lambda r: r["value"]).alias("values"),
    )
    return grouped


def payload(summary: DataFrame, n_runs: int) -> dict[str, Any]:
    """The summary as one JSON-able record: a few rows for each method, whatever the number of papers."""
    out: dict[str, Any] = {"n_runs": n_runs, "groups": {}}
    for r in summary.orderBy(*KEYS, "metric").collect():
        group = out["groups"].setdefault("/".join(r[k] or "" for k in KEYS), {})
        group[r["metric"]] = {"mean": r["mean"], "std": r["std"], "values": r["values"]}
    return out


def console_table(summary: DataFrame) -> str:
    """The summary as aligned text, a table for each group."""
    lines, last = [], None
    for r in summary.orderBy(*KEYS, "metric").collect():
        if (now := tuple(r[k] for k in KEYS)) != last:
            lines += ["", f"{' / '.join(x or '-' for x in now)}  ({r['n_runs']} runs)", f"{'metric':<20}{'mean':>10}{'std':>10}"]
            last = now
        lines.append(f"{r['metric']:<20}{r['mean']:>10.4f}{r['std']:>10.4f}")
    return "\n".join(lines[1:])
