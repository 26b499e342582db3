"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; all but the last return the columns of ``documents``. Between stages the
rows are written to the folder the session's executors share and read back.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm import exact, near, packing, pii, quality
from citeloom.llm.common import forget, fresh, materialise, prepare, read_table, text_of

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Documents of a lower score are rejected.
LEAST_QUALITY = 0.5


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the compression classifier rejects."""
    prepare(spark)
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    score = fresh(docs, "score")
    return quality.scored(docs, model, "text", score).filter(F.col(score) >= LEAST_QUALITY).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with one text, the one with the largest id stays."""
    prepare(spark)
    return exact.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates (five words, 0.8), the one with the least id stays."""
    prepare(spark)
    return near.near_dedup(docs, near.Plan(words=5))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data, and terms that reveal it, by the names of their kinds."""
    prepare(spark)
    found = pii.find(docs, "doc_id", "text")
    spans = F.col(found.columns[-1])
    clean = found.withColumn("text", F.when(F.size(spans) > 0, pii.sanitise(text_of("text"), spans)).otherwise(F.col("text")))
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1,024 tokens, with their ids and place in the sequences."""
    prepare(spark)
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("personal_data", hide_personal_data),
    ("packing", pack_sequences),
]

#: The classifier can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), name)
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
