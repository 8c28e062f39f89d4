"""Token ids of documents in a compact binary store.

Every document's ids are serialized as little-endian integers (two bytes if the vocabulary fits,
else four) and compressed alone with zstandard under one shared dictionary, trained on the
serialized ids of a bounded sample of documents. A store is three folders of Parquet:

* ``dictionary``: one row: SHA-256 of the dictionary, its bytes, width of an id,
* ``shards``: rows of consecutive documents, up to ``shard_bytes`` of frames joined in ``blob``,
  with doc_ids, frame sizes and id counts as arrays beside it, in ascending doc_id order,
* the ``offset index`` is those arrays: reading it does not touch the blobs, and one document is
  one slice of one blob.

Rows are range-partitioned by doc_id before tokenizing; the tie breaker is a hash of the text,
so one id with very many rows still spreads (equal rows are interchangeable).

Defined results: a null or empty text is the end id alone. Null doc_ids come first. Rows that
repeat a doc_id are documents of their own, ordered by the hash of their text. No documents give
an empty store. A very long document is one frame. Readers raise if a blob was written with
another dictionary than the stored one.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from archivesearch.llm.shared import col, hashed_sample
from archivesearch.llm.tokenizing import id_encoder

END_ID = 2
#: Bounds of the dictionary's training: documents of the sample, their longest text, dictionary size.
SAMPLE_DOCS = 2000
SAMPLE_CHARS = 16384
DICTIONARY_BYTES = 65536
SHARD_BYTES = 4 << 20
LEVEL = 3
_SHARDS = ("part int, shard int, dictionary string, doc_ids array<long>, sizes array<int>, "
           "counts array<long>, n_ids long, blob binary")


def train_dictionary(docs: DataFrame, tokenizer: str, sample_docs: int = SAMPLE_DOCS) -> tuple[bytes, int]:
    """Dictionary bytes (empty if there is too little to learn from) and the width of an id. The
    sample are the ``sample_docs`` documents with the smallest hash among those of at most
    ``SAMPLE_CHARS`` characters (fewer, but a quarter at least, where most documents are longer); only
    the dictionary depends on it, all ids of all are stored."""
    encoder = id_encoder(tokenizer)
    width = 2 if encoder.size < 1 << 16 else 4
    short = F.length(col("text")).between(1, SAMPLE_CHARS)
    few = docs.filter(short).select(col("doc_id").alias("doc_id"), col("text").alias("t"))
    # The number of all documents comes from the files' footers; that of the short ones would take a scan.
    rows = hashed_sample(few, ["doc_id", "t"], sample_docs, total=docs.count()).collect()
    if len(rows) < sample_docs // 4:
        rows = hashed_sample(few, ["doc_id", "t"], sample_docs).collect()
    samples = [ids.astype(f"<u{width}").tobytes() for ids in encoder.encode_all([r.t for r in rows])]
    total = sum(map(len, samples))
    if len(samples) < 16 or total < 4096:
        return b"", width
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, total // 8), samples).as_bytes(), width
    except zstandard.ZstdError:  # the samples have nothing in common
        return b"", width


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID,
                partitions: int | None = None, shard_bytes: int = SHARD_BYTES) -> None:
    spark = docs.sparkSession
    dictionary, width = train_dictionary(docs, tokenizer)
    mark = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(mark, bytearray(dictionary), width)], "hash string, bytes binary, width int"
                          ).coalesce(1).write.parquet(f"{path}/dictionary")
    shared = spark.sparkContext.broadcast(dictionary)  # at most DICTIONARY_BYTES

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, number = id_encoder(tokenizer), TaskContext.get().partitionId(), 0
        known = zstandard.ZstdCompressionDict(shared.value) if shared.value else None
        compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=known).compress
        end = np.array([end_id], np.uint32)
        ids, frames, counts, size = [], [], [], 0

        def shard() -> pa.RecordBatch:
            row = {"part": part, "shard": number, "dictionary": mark, "doc_ids": ids,
                   "sizes": [len(f) for f in frames], "counts": counts, "n_ids": sum(counts), "blob": b"".join(frames)}
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()),
                     pa.list_(pa.int64()), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds)], names=list(row))

        texts = ((i, t.as_py()) for b in batches for i, t in zip(b.column(0).to_pylist(), b.column(1)))
        for doc_id, tokens in encoder.stream(texts):
            tokens = np.concatenate([tokens, end])
            frame = compress(tokens.astype(f"<u{width}").tobytes())
            ids.append(doc_id)
            frames.append(frame)
            counts.append(len(tokens))
            size += len(frame)
            if size >= shard_bytes:
                yield shard()
                ids, frames, counts, size, number = [], [], [], 0, number + 1
        if ids:
            yield shard()

    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64("text")
    rows = docs.select(col("doc_id").cast("long").alias("doc_id"), col("text").alias("text"))
    (rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), tie)
     .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)
     .mapInArrow(shards, _SHARDS).write.option("parquet.block.size", 4 * shard_bytes).parquet(f"{path}/shards"))


def _shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_SHARDS).parquet(f"{path}/shards")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The offset index: doc_id, part, shard, place (in the shard), at and size (bytes in the blob),
    n_tokens, start (ids of all documents before it). Reads no blob."""
    rows = _shards(spark, path).select("part", "shard", "n_ids", "doc_ids", "sizes", "counts")
    # Ids before a shard: of the parts before its part, and of the shards before it in its part.
    parts = rows.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before_part"))
    own = W.partitionBy("part").orderBy("shard")
    rows = (rows.withColumn("before", F.sum("n_ids").over(own) - F.col("n_ids"))
            .join(parts, "part").withColumn("before", F.col("before") + F.col("before_part")))

    each = F.posexplode(F.arrays_zip("doc_ids", "sizes", "counts"))
    # Running sums within a shard by a window: the arrays can have many thousands of documents.
    flat = rows.select("part", "shard", "before", each.alias("place", "d")).select(
        "part", "shard", "place", "before", F.col("d.doc_ids").alias("doc_id"),
        F.col("d.sizes").alias("size"), F.col("d.counts").alias("n_tokens"))
    inside = W.partitionBy("part", "shard").orderBy("place")
    return flat.select(
        "doc_id", "part", "shard", "place", (F.sum("size").over(inside) - F.col("size")).alias("at"), "size",
        "n_tokens", (F.col("before") + F.sum("n_tokens").over(inside) - F.col("n_tokens")).alias("start"))


def _dictionary(spark: SparkSession, path: str) -> tuple[str, bytes, int]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    return row["hash"], bytes(row["bytes"]), row["width"]


def read_store(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """``(doc_id, part, shard, place, ids)`` of all documents, or of the few ``doc_ids``: then only
    shards that hold one are read, and of those only the frames asked for are decompressed."""
    return _read(spark, path, doc_ids, bytes, pa.binary(), "ids binary")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, part, shard, place, ids_crc32)`` of all documents; the ids stay in the tasks that read them."""
    return _read(spark, path, None, zlib.crc32, pa.int64(), "ids_crc32 long")


def _read(spark: SparkSession, path: str, doc_ids: list[int] | None, value, kind: pa.DataType, field: str) -> DataFrame:
    mark, dictionary, width = _dictionary(spark, path)
    shared = spark.sparkContext.broadcast(dictionary)
    rows = _shards(spark, path)
    wanted = None
    if doc_ids is not None:
        wanted = set(doc_ids)
        rows = rows.filter(F.arrays_overlap("doc_ids", F.array(*[F.lit(int(i)).cast("long") for i in wanted]))
                           if wanted else F.lit(False))
    names, kinds = ["doc_id", "part", "shard", "place", field.split()[0]], (pa.int64(), pa.int32(), pa.int32(), pa.int32(), kind)

    def found(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = zstandard.ZstdCompressionDict(shared.value) if shared.value else None
        expand = zstandard.ZstdDecompressor(dict_data=known).decompress
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name: batch.column(batch.schema.get_field_index(name))[row]
                if get("dictionary").as_py() != mark:
                    raise ValueError(f"the shard was written with dictionary {get('dictionary')}, not {mark}")
                blob, at, out = memoryview(get("blob").as_buffer()), 0, []
                size = 0
                part, shard = get("part").as_py(), get("shard").as_py()
                for place, (doc_id, length) in enumerate(zip(get("doc_ids").as_py(), get("sizes").as_py())):
                    if wanted is None or doc_id in wanted:
                        ids = np.frombuffer(expand(blob[at:at + length]), f"<u{width}").astype("<u4").tobytes()
                        out.append((doc_id, part, shard, place, value(ids)))
                        size += len(ids)
                    at += length
                    if size >= 16 << 20:
                        yield found(out)
                        out, size = [], 0
                if out:
                    yield found(out)

    return rows.mapInArrow(documents, f"doc_id long, part int, shard int, place int, {field}")


def digest(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a store: doc_id, start, n_tokens, ids_crc32 (all from the files)."""
    sums = checksums(spark, path).select("part", "shard", "place", "ids_crc32")
    return (read_index(spark, path).join(sums, ["part", "shard", "place"])
            .select("doc_id", "start", "n_tokens", "ids_crc32"))
