"""Writers: partitioned JSON lines, Parquet, and small reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One object a line; nulls are written, non-ASCII text stays as it is."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_papers(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def metrics_json(df: DataFrame) -> str:
    """A one-row frame as pretty JSON."""
    row = df.select(F.to_json(F.struct("*")).alias("j")).first()
    return json.dumps(json.loads(row["j"]) if row else {}, indent=2, ensure_ascii=False)


def write_manifest(df: DataFrame, path: str) -> None:
    """(name, size) of files read as binaryFile."""
    df.select(F.element_at(F.split("source_path", "/"), -1).alias("name"), F.col("length").alias("size")).write.mode("overwrite").json(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One small text (a report, a metrics file) to a path in any store that Spark reaches."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()


def write_record(spark: SparkSession, record: dict, path: str) -> None:
    write_text(spark, json.dumps(record, indent=2, ensure_ascii=False) + "\n", path)
