"""Declarative chains of DataFrame stages, and the evaluation plan."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions.prompts import FULL_TEXT, PASSAGES, with_prompt
from citeloom.operators.candidates import select_passages
from citeloom.operators.extract import Extractor, extract, extract_by_pattern
from citeloom.operators.flatten import flatten_references
from citeloom.operators.match import match
from citeloom.operators.metrics import coverage, failure_buckets, macro_metrics, micro_metrics
from citeloom.operators.report import top_failures
from citeloom.session import exists
from citeloom.sources.sinks import write_text

Stage = Callable[[DataFrame], DataFrame]
#: Ending of the file beside a kept stage's folder that says what it was made of.
MARK = ".mark"


def content_digest(df: DataFrame) -> str:
    """A digest of df's rows, whatever their order: one aggregate over all columns, one row to the driver."""
    columns = [F.to_json(F.col(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema.fields]
    # A null and what stands beside it must not change places.
    present = F.concat(*[F.when(c.isNull(), "0").otherwise("1") for c in columns]) if columns else F.lit("")
    seeds = [F.xxhash64(F.lit(seed), present, *columns) for seed in (1, 2)]
    row = df.select(*[h.alias(f"h{i}") for i, h in enumerate(seeds)]).agg(F.count("*").alias("n"), F.bit_xor("h0").alias("x"), F.sum(F.col("h1").cast("decimal(38,0)")).cast("string").alias("s")).first()
    return f"{df.schema.simpleString()}:{row['n']}:{row['x']}:{row['s']}"


@dataclass
class Pipeline:
    """Named stages; a stage named in ``keep`` is written below ``folder`` and read back.

    With resume, a kept stage that is already there is read and not computed
    again, if it was made of the same rows by the same plan: next to the rows
    lies a fingerprint of the input's content, the plans of the stages up to
    here, and their versions. What a plan doesn't show (an extractor's code, a
    model) belongs into ``versions``, by stage name.
    """

    stages: list[tuple[str, Stage]]
    folder: str | None = None
    keep: set[str] = field(default_factory=set)
    versions: dict[str, str] = field(default_factory=dict)

    def run(self, df: DataFrame, resume: bool = False) -> DataFrame:
        spark, kept = df.sparkSession, bool(self.folder and self.keep)
        mark = content_digest(df) if kept else ""
        for name, stage in self.stages:
            made = df.transform(stage)
            if not kept:
                df = made
                continue
            plan = re.sub(r"#\d+L?|@[0-9a-f]{5,}|0x[0-9a-f]+", "", made._jdf.queryExecution().analyzed().canonicalized().toString())
            mark = hashlib.sha256("\n".join((mark, name, self.versions.get(name, ""), plan)).encode()).hexdigest()
            df = made
            if name in self.keep:
                path = f"{self.folder}/{name}"
                if not (resume and self._holds(spark, path, mark)):
                    made.write.mode("overwrite").parquet(path)
                    write_text(spark, mark, f"{path}{MARK}")
                df = spark.read.parquet(path)
        return df

    @staticmethod
    def _holds(spark: SparkSession, path: str, mark: str) -> bool:
        if not (exists(spark, f"{path}/_SUCCESS") and exists(spark, f"{path}{MARK}")):
            return False
        return spark.read.option("wholetext", True).text(f"{path}{MARK}").first()["value"] == mark


def passages_pipeline(extractor: Extractor | None = None, folder: str | None = None) -> Pipeline:
    """Papers to predictions, reading selected passages only; an extractor gets the whole prompt of a paper."""
    call = extract_by_pattern if extractor is None else lambda d: extract(with_prompt(d, PASSAGES), extractor, "prompt")
    return Pipeline([("passages", select_passages), ("extract", call), ("flatten", flatten_references)], folder, {"extract"})


def full_text_pipeline(extractor: Extractor | None = None, folder: str | None = None) -> Pipeline:
    """Papers to predictions, reading whole texts."""
    call = (lambda d: extract_by_pattern(d, "full_text")) if extractor is None else (lambda d: extract(with_prompt(d, FULL_TEXT), extractor, "prompt"))
    return Pipeline([("extract", call), ("flatten", flatten_references)], folder, {"extract"})


def evaluate(predictions: DataFrame, truth: DataFrame) -> dict[str, DataFrame]:
    """All metrics of normalized predictions against normalized truth, as frames."""
    pair, triple = match(predictions, truth), match(predictions, truth, True)
    return {
        "pair_micro": micro_metrics(pair), "pair_macro": macro_metrics(pair), "triple_micro": micro_metrics(triple), "triple_macro": macro_metrics(triple),
        "coverage": coverage(predictions, truth), "pair_failures": failure_buckets(pair), "triple_failures": failure_buckets(triple),
    }


def metrics_record(predictions: DataFrame, truth: DataFrame, label: str = "", model: str = "", benchmark: str = "", examples: int = 5) -> dict:
    """All metrics of a run as one JSON-able record, as report.load_metrics() reads it.

    Failures are counted whole; of each kind the first examples in key order are named.
    """
    frames = evaluate(predictions, truth)
    plain = lambda name: frames[name].first().asDict()
    failures = frames["pair_failures"]
    counted = {r["bucket"]: r["count"] for r in failures.groupBy("bucket").count().collect()}
    named: dict[str, list] = {}
    for r in top_failures(failures, examples).orderBy("bucket", "n").collect():
        named.setdefault(r["bucket"], []).append([r["paper"], r["ds"]])
    out = {"label": label, "model": model, "benchmark": benchmark} | {k: plain(k) for k in ("pair_micro", "pair_macro", "triple_micro", "triple_macro", "coverage")}
    return out | {"failures": {k: {"n": counted[k], "examples": named[k]} for k in sorted(counted)}}
