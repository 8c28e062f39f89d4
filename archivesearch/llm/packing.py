"""Packing by power-of-two decomposition.

A document's ids (closed by an end id) are cut from the left into the longest powers of two that
fit: pieces of ``max_length``, then the binary digits of the rest. Each piece is a sequence of
its own, so no sequence crosses documents, and since every sequence length is a power of two
nothing is padded. Sequences of one length form a bucket: ``write_buckets`` stores each length in a
folder of its own, for training batches of equal shape, and ``read_buckets`` gives them back.

Defined results: a null or empty text is the end id alone, one piece of length 1. Repeated rows
are packed each for itself and keep their own sequences. A document is tokenized and cut within
its task, whatever its length; there is no shuffle. No documents give no rows. Sequence ids are
unique, and grow with the partition and the row of the piece in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivesearch.llm.shared import col, shared_path
from archivesearch.llm.tokenizing import id_encoder

MAX_LENGTH = 2048
END_ID = 1
_ROWS = 4096  # pieces in a batch that goes back to Spark


def cuts(n: int, max_length: int = MAX_LENGTH) -> list[int]:
    """Lengths of the pieces of ``n`` ids: full pieces, then the binary digits of the rest."""
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    rest = n % max_length
    return [max_length] * (n // max_length) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer: str, end_id: int = END_ID, max_length: int = MAX_LENGTH) -> DataFrame:
    """One row per sequence: sequence_id, length, ids (little-endian unsigned 32-bit), and its one
    piece: doc_id, start (the document's ids before it), doc_tokens, offset (0)."""
    cuts(0, max_length)
    schema = "doc_id long, start long, length int, doc_tokens long, ids binary"
    names = ["doc_id", "start", "length", "doc_tokens", "ids"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = id_encoder(tokenizer)
        end = np.array([end_id], "<u4")
        rows: list[tuple] = []
        texts = ((i, t.as_py()) for b in batches for i, t in zip(b.column(0).to_pylist(), b.column(1)))
        for doc_id, ids in encoder.stream(texts):
            ids = np.concatenate([ids, end])
            start = 0
            for length in cuts(len(ids), max_length):
                rows.append((doc_id, start, length, len(ids), ids[start:start + length].tobytes()))
                start += length
                if len(rows) >= _ROWS:
                    yield _batch(rows, names)
                    rows = []
        if rows:
            yield _batch(rows, names)

    out = docs.select(col("doc_id").cast("long").alias("doc_id"), col("text").alias("text")).mapInArrow(pieces, schema)
    return out.select(F.monotonically_increasing_id().alias("sequence_id"), "length", "ids",
                      "doc_id", "start", "doc_tokens", F.lit(0).cast("long").alias("offset"))


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def digest(packed: DataFrame) -> DataFrame:
    """Per piece its place and the checksum of its ids."""
    return packed.select("doc_id", "start", F.col("length").cast("long").alias("length"),
                         F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def write_buckets(packed: DataFrame, path: str) -> None:
    """Store the sequences as Parquet, one folder per length. Every task writes its own file of each length: no shuffle."""
    packed.write.partitionBy("length").option("compression", "zstd").parquet(path)


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    """The sequences of all lengths; a filter on ``length`` reads only its folder."""
    return spark.read.schema("sequence_id long, ids binary, doc_id long, start long, doc_tokens long, offset long, length int").parquet(path)


def bucketed(docs: DataFrame, tokenizer: str, end_id: int = END_ID, max_length: int = MAX_LENGTH) -> DataFrame:
    """Pack, store by length in the shared folder, and read back."""
    path = shared_path(docs.sparkSession, "buckets")
    write_buckets(pack(docs, tokenizer, end_id, max_length), path)
    return read_buckets(docs.sparkSession, path)
