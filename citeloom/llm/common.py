"""Shared plumbing of the training-data operators.

Conventions that hold for every operator in this subpackage unless its own
docstring says otherwise:

* a null text counts as the empty text; a null id is carried through as null;
* repeated input rows give repeated output rows;
* an empty table gives an empty result with the same schema;
* columns the operator does not name are ignored, whatever they are called.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Session settings that name the folder all executors share, and the local
#: stand-in used only where the session names none (tests, local mode).
CHECKPOINT_CONF = "spark.checkpoint.dir"
ARROW_ROWS, MOST_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1024
LOCAL_CHECKPOINT_DIR = "/tmp/checkpoints/citeloom"


def prepare(spark: SparkSession) -> None:
    """Settings that every operator needs of the session.

    Lets Python workers on this machine import the package from where the driver has it.

    On a cluster the package is shipped with the job (--py-files) instead; a
    path that doesn't exist there does no harm.
    """
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))
    # Batches of the default 10,000 rows are too much memory for long texts.
    if int(spark.conf.get(ARROW_ROWS)) > MOST_ARROW_ROWS:
        spark.conf.set(ARROW_ROWS, str(MOST_ARROW_ROWS))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from the session; a local one only where both are one process."""
    if named := spark.conf.get(CHECKPOINT_CONF, None):
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    return f"file://{LOCAL_CHECKPOINT_DIR}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back.

    Cuts lineage so that a lost executor costs a re-read, not a re-computation,
    and freezes row placement for operators that take several passes. What
    forget() has not removed before goes when the application ends.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{tag}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete what materialise() wrote, once nothing to come reads it."""
    for df in frames:
        if path := getattr(df, "stored_at", None):
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    return next(x for x in (name, *(f"{name}_{i}" for i in range(1, len(taken) + 2))) if x.lower() not in taken)


def text_of(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def rows_of(batches: Iterable[pa.RecordBatch], columns: tuple[str, ...], size: int = 256) -> Iterator[tuple]:
    """Rows of record batches as Python values, a few at a time."""
    for batch in batches:
        for at, n in slices(batch.num_rows, size):
            part = batch.slice(at, n)
            yield from zip(*[part.column(c).to_pylist() for c in columns], strict=True)


def slices(n: int, size: int):
    for at in range(0, n, size):
        yield at, min(size, n - at)
