"""Packing of tokenised documents into fixed windows (operator 2).

Concatenate and cut. A first pass tokenises each partition and notes for each
document where it begins among its partition's tokens; what it writes is kept
in the shared folder, so ids are computed once and row placement is frozen.
Prefix sums over the partitions' totals (one row for each partition) give every
document its place in the one long sequence, and a second pass cuts that at
every multiple of the window. A document that a cut runs through gives one
piece on each side; those are the boundary records.

Only the very last sequence can be shorter than the window: padding is at most
window - 1 ids for the whole corpus.
"""

from __future__ import annotations

import gc
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.llm.bpe import read_vocabulary
from citeloom.llm.common import materialise, slices, text_of
from citeloom.llm.hf import cached_encoder

WINDOW, END_ID = 1024, 0
ROWS_AT_ONCE = 256
BROADCAST_PARTS = 1_000_000


def padded_length(length: int, window: int = WINDOW) -> int:
    """Length after padding: the window, except for lengths that are a power of two."""
    return length if length and length & (length - 1) == 0 else window


def token_rows(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, end_id: int) -> DataFrame:
    """(id, part, begin, n, ids): a document's ids and its place in its partition.

    ids is binary, two or four little-endian bytes an id (``wide``).
    """
    digest, data = read_vocabulary(tokenizer)
    sent = docs.sparkSession.sparkContext.broadcast(data)
    rows = docs.select(docs[id_col].alias("id"), text_of(docs[text_col]).alias("text"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("part", T.IntegerType()), T.StructField("begin", T.LongType()), T.StructField("n", T.LongType()), T.StructField("wide", T.BooleanType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        encoder = cached_encoder(digest, sent.value)
        part, begin = TaskContext.get().partitionId(), 0
        tail = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at, size in slices(batch.num_rows, ROWS_AT_ONCE):
                piece = batch.slice(at, size)
                begins, counts, wides, out = [], [], [], []
                for raw in encoder.encode_texts(piece.column("text").to_pylist()):
                    ids = np.frombuffer(raw + tail, "<u4")
                    begins.append(begin)
                    counts.append(len(ids))
                    begin += len(ids)
                    wides.append(wide := bool(ids.max() > 0xFFFF))
                    out.append((ids if wide else ids.astype("<u2")).tobytes())
                yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array([part] * size, pa.int32()), pa.array(begins, pa.int64()), pa.array(counts, pa.int64()), pa.array(wides, pa.bool_()), pa.array(out, pa.binary())], schema.names)

    return rows.mapInArrow(run, schema)


def place(tokens: DataFrame) -> DataFrame:
    """Add ``origin``, the number of ids before a document in the whole corpus.

    The totals are one row for each partition of the first pass, a number that
    the input's splits set and its rows do not; they are summed in one task.
    While there are BROADCAST_PARTS of them at most (24 bytes each) they are
    broadcast, so that the ids stay where they are; more are joined by a shuffle.
    """
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    offsets = materialise(offsets, "offsets")
    if offsets.count() <= BROADCAST_PARTS:
        offsets = F.broadcast(offsets)
    return tokens.join(offsets, "part").withColumn("origin", F.col("base") + F.col("begin"))


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row for each piece of a document.

    Returns (id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset)
    and, with_ids, the piece's ids as an array. A document without text has the
    end id alone. Every id is in exactly one piece, pieces fill sequences
    0, 1, 2, ... from offset 0 without gaps.
    """
    tokens = materialise(token_rows(docs, tokenizer, id_col, text_col, end_id), "tokens")
    placed = place(tokens).select("id", "n", "wide", "ids", "origin")
    fields = [T.StructField("id", tokens.schema["id"].dataType)] + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    schema = T.StructType(fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, size in slices(batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, size)
                rows, starts, lengths, crcs, totals, sequences, offsets, pieces = [], [], [], [], [], [], [], []
                for row, (n, wide, raw, origin) in enumerate(zip(*[part.column(c).to_pylist() for c in ("n", "wide", "ids", "origin")], strict=True)):
                    ids = memoryview(np.frombuffer(raw, "<u4" if wide else "<u2").astype("<u4").tobytes())
                    start = 0
                    while start < n:
                        offset = (origin + start) % window
                        length = min(n - start, window - offset)
                        piece = ids[4 * start : 4 * (start + length)]
                        rows.append(row)
                        starts.append(start)
                        lengths.append(length)
                        crcs.append(zlib.crc32(piece))
                        totals.append(n)
                        sequences.append((origin + start) // window)
                        offsets.append(offset)
                        if with_ids:
                            pieces.append(np.frombuffer(piece, "<u4").astype(np.int32))
                        start += length
                columns = [part.column("id").take(pa.array(rows, pa.int64())), *[pa.array(c, pa.int64()) for c in (starts, lengths, crcs, totals, sequences, offsets)]]
                if with_ids:
                    columns.append(pa.array(pieces, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return placed.mapInArrow(cut, schema).withColumnRenamed("id", id_col)
