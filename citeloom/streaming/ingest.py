"""Papers as they arrive: the batch stages over a file stream.

Not something the batch tool has; its skip-if-present incrementality becomes
a checkpointed file source here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from citeloom.operators.candidates import select_passages
from citeloom.operators.extract import extract_by_pattern
from citeloom.operators.flatten import flatten_references


def stream_papers(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def stream_predictions(papers: DataFrame) -> DataFrame:
    return flatten_references(extract_by_pattern(select_passages(papers)))


def write_stream(df: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    return df.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
