"""What Python workers need of the session."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where the driver has it.

    On a cluster the package is shipped with the job (--py-files) instead.
    """
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in any store that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


#: Session setting that names the folder all executors share, and what stands in for it in local mode only.
CHECKPOINT_CONF = "spark.checkpoint.dir"
LOCAL_FOLDER = "file:///tmp/checkpoints/citeloom"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df, written to the folder that all executors share and read back; it goes when the application ends."""
    spark = df.sparkSession
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        folder = LOCAL_FOLDER
    path = f"{folder}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)
