"""Compression classifier of text quality (operator 7).

Two zstandard dictionaries are built, one from good and one from bad labelled
texts. A text is compressed under each, in blocks short enough for the
dictionary to matter throughout, and the normalised difference of the two
sizes says which texts it resembles. How far the text compresses by itself
tells repetitive junk, which looks the same under either dictionary. A
logistic curve over both, fitted on labelled texts that the dictionaries have
not seen, turns them into a calibrated score.

Fitting uses a bounded sample: at most ``sample`` texts of each label, each of
at most ``sample_bytes`` bytes, half for the dictionaries and half for the
curve, whatever the size of the corpus. Which rows those are follows from a
hash of their ids. Every text is scored, whole.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import slices, text_of

SAMPLE, SAMPLE_BYTES = 600, 1 << 17
DICTIONARY_BYTES, BLOCK = 1 << 16, 512
ROWS_AT_ONCE = 256


def blocks(data: bytes) -> list[bytes]:
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)] or [b""]


@dataclass
class Model:
    """Dictionaries, scaling and weights; about 130 kB, whatever the corpus."""

    good: bytes
    bad: bytes
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def __post_init__(self):
        self._tools = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_tools"} | {"_tools": None}

    def features(self, text: str) -> tuple[float, float]:
        """Normalised size difference, and log of the text's own compressed share."""
        if self._tools is None:
            dictionary = lambda d: zstandard.ZstdCompressionDict(d) if d else None
            self._tools = [zstandard.ZstdCompressor(level=1, dict_data=dictionary(d), write_content_size=False, write_dict_id=False) for d in (self.good, self.bad, b"")]
        good, bad, alone = self._tools
        data = text.encode()
        cut = blocks(data)
        a, b = sum(len(good.compress(x)) for x in cut), sum(len(bad.compress(x)) for x in cut)
        return (b - a) / (a + b), float(np.log(len(alone.compress(data)) / max(1, len(data))))

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        return np.column_stack([np.ones(len(z)), z, z[:, 0] ** 2, z[:, 0] * z[:, 1], z[:, 1] ** 2])

    def score(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        x = np.array([self.features(t) for t in texts])
        return 1 / (1 + np.exp(-np.clip(self.expand(x) @ self.weights, -30, 30)))


def build_dictionary(texts: list[str]) -> bytes:
    """A zstandard dictionary; empty if the texts are too few or short for one."""
    parts = [p for t in texts for p in blocks(t.encode()) if p]
    size = min(DICTIONARY_BYTES, sum(map(len, parts)) // 4)
    if size < 1024 or len(parts) < 16:
        return b""
    try:
        return zstandard.train_dictionary(size, parts).as_bytes()
    except zstandard.ZstdError:  # the samples have nothing in common
        return b""


def fit_model(good: list[str], bad: list[str], rounds: int = 40, ridge: float = 0.1) -> Model:
    """Dictionaries from the first half of each list, the curve from the rest.

    With no text of one label the score is constant: 1 if only good texts are
    known, 0 if only bad ones, and 0.5 with no labels at all.
    """
    model = Model(build_dictionary(good[::2]), build_dictionary(bad[::2]), np.zeros(2), np.ones(2), np.zeros(6))
    if not good or not bad:
        model.weights[0] = 30.0 * (bool(good) - bool(bad))
        return model
    held = [(t, 1.0) for t in (good[1::2] or good)] + [(t, 0.0) for t in (bad[1::2] or bad)]
    x, y = np.array([model.features(t) for t, _ in held]), np.array([v for _, v in held])
    model.centre, model.scale = x.mean(0), x.std(0) + 1e-6
    a = model.expand(x)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ model.weights, -30, 30)))
        hessian = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(a.shape[1])
        model.weights = model.weights - np.linalg.solve(hessian, a.T @ (p - y) + ridge * model.weights)
    return model


def fold(id_col: str, folds: int = 4):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_fold: int = 2, sample: int = SAMPLE) -> Model:
    """Fit on labelled rows outside the held-out fold; null texts and labels don't teach.

    Where an id repeats, each of its texts has its label; an id with both labels teaches both.
    """
    texts = {}
    for label in (1, 0):
        known = labels.filter((F.col(label_col) == label) & (fold(id_col) != held_fold)).select(F.col(id_col).alias("_id")).distinct()
        rows = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text")).filter(F.col("_text").isNotNull() & (F.octet_length("_text") <= SAMPLE_BYTES))
        ranked = known.orderBy(F.xxhash64("_id"), "_id").limit(2 * sample)
        # 2 * sample ids at most are broadcast, and as many texts come back.
        got = rows.join(F.broadcast(ranked), "_id").orderBy(F.xxhash64("_id"), "_id", "_text").limit(sample).collect()
        texts[label] = [r["_text"] for r in got]
    return fit_model(texts[1], texts[0])


def scored(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "quality_score") -> DataFrame:
    """All columns of docs and the score of each text, 0 to 1; null counts as empty.

    A column of docs that is called score_col is replaced.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != score_col.lower()])
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select("*", F.lit(0.0).alias(score_col)).schema
    at = docs.columns.index(text_col)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        own = sent.value
        for batch in batches:
            for start, size in slices(batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, size)
                texts = [t or "" for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own.score(texts), pa.float64())], names)

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, score, predicted) of every row."""
    model = fit(docs, labels, id_col, text_col)
    rows = docs.select(docs[id_col].alias("id"), text_of(docs[text_col]).alias("text"))
    # Texts end here: only their scores leave the workers.
    out = scored(rows, model, "text", "score").select(F.col("id").alias(id_col), (fold("id") == 2).alias("held_out"), "score")
    return out.withColumn("held_out", F.coalesce("held_out", F.lit(False))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
