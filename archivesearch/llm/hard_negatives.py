"""Hard-negative mining with Kronecker-packed products.

A block of candidates is packed dimension by dimension: their components, biased so that none is
negative, stand in fields of one wide integer, one field a candidate. An anchor then needs one
product per component for the whole block: the sum of component times wide integer holds all its
inner products side by side, in fields wide enough that none runs over into the next. Unpacked and
without the bias they are exact.

Anchors are a stated share of the rows and meet all rows: they are stored in blocks of bounded
size, and one block at a time is broadcast and released after use. In the first pass each task keeps
the best positives of every anchor of the block, in the second the best negatives of every
(anchor, positive) within its score window; a window over those few rows merges the tasks. No pair of
rows is shuffled that is not among the best of its task. Each block's result is stored before
the next one begins.

Defined results: rows with a null vec_id or label, a null vector, or a null or non-finite component take no
part. Vectors of different length are compared as if the shorter ended in zeros. Repeated rows count as rows of
their own, but an anchor that stands twice is asked once; the other rows of an anchor are those with another
vec_id. Anchors that share a vec_id and differ are asked each (column anchor_row tells them apart).
No anchors, positives or negatives give no rows. Components beyond ``vectors.LIMIT`` are clamped.
Extra columns are not read; labels are integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivesearch.llm.shared import col, shared_path, stored
from archivesearch.llm.vectors import matrix, scaled, usable

_CANDIDATES = 4096  # fields of a wide integer
_BLOCK_BYTES = 16 << 20  # of an anchor block
RESULT = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long, "
          "anchor_row long, positive_rank int")


@dataclass(frozen=True)
class Settings:
    """A negative's score is at least ``low`` and at most ``high`` hundredths of the positive's."""

    positives: int = 5
    negatives: int = 5
    low: int = 80
    high: int = 100
    block: int = 4096  # anchors


class Packed:
    """Candidates whose products with an anchor are one sum over its components."""

    def __init__(self, rows: np.ndarray, largest: int):
        """``largest``: the largest sum of magnitudes of an anchor."""
        self.n, width = rows.shape
        self.bias = min(0, int(rows.min(initial=0)))
        fields = (rows - self.bias).astype("<u8")
        # No product sum lies further from zero than this; added to each field, it keeps fields from borrowing.
        self.middle = int(fields.max(initial=0)) * largest
        self.bytes = 4 if 2 * self.middle < 1 << 32 else 8
        if 2 * self.middle >= 1 << 64:
            raise ValueError("vectors are too long for fields of eight bytes")
        kind = f"<u{self.bytes}"
        self.wide = [int.from_bytes(fields[:, k].astype(kind).tobytes(), "little") for k in range(width)]
        self.base = int.from_bytes(np.full(self.n, self.middle, kind).tobytes(), "little")

    def products(self, anchor: list[int]) -> np.ndarray:
        total = sum(map(mul, anchor, self.wide), self.base)
        fields = np.frombuffer(total.to_bytes(self.n * self.bytes, "little"), f"<u{self.bytes}")
        return (fields - np.uint64(self.middle)).astype(np.int64) + self.bias * sum(anchor)


def _best(scores: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``n`` rows with the highest scores, ties by smaller id."""
    if len(scores) > 4 * n:
        bar = np.partition(scores, len(scores) - n)[len(scores) - n]
        keep = scores >= bar
        scores, ids = scores[keep], ids[keep]
    order = np.lexsort((ids, -scores))[:n]
    return scores[order], ids[order]


class _Asked:
    """A block of anchors as tasks hold it."""

    def __init__(self, rows: pa.Table, width: int):
        self.number, self.ids, self.labels = (rows[n].to_numpy() for n in ("number", "vec_id", "label"))
        vectors = matrix(rows["v"].combine_chunks(), width)
        self.vectors, self.width = vectors.tolist(), width
        self.largest = int(np.abs(vectors).sum(axis=1).max(initial=0))

    def against(self, batches: Iterator[pa.RecordBatch], collect) -> dict:
        """For every group that ``collect(anchor, scores, ids, labels)`` yields as (group, limit, scores, ids), its
        best rows over all batches."""
        best: dict = {}
        for batch in batches:
            for a in range(0, batch.num_rows, _CANDIDATES):
                some = batch.slice(a, _CANDIDATES)
                ids, labels = some.column(0).to_numpy(), some.column(1).to_numpy()
                packed = Packed(matrix(some.column(2), self.width), self.largest)
                for k, anchor in enumerate(self.vectors):
                    for group, n, scores, own in collect(k, packed.products(anchor), ids, labels):
                        if group in best:
                            scores, own = np.concatenate([best[group][0], scores]), np.concatenate([best[group][1], own])
                        best[group] = _best(scores, own, n)
        return best


def mine(rows: DataFrame, anchors: Column, settings: Settings = Settings()) -> DataFrame:
    """Hard negatives of the rows (columns vec_id, embedding, label) that ``anchors`` marks."""
    spark = rows.sparkSession
    kept = rows.filter(usable(col("embedding"))).select(
        col("vec_id").cast("long").alias("vec_id"), col("label").cast("long").alias("label"), scaled(col("embedding")).alias("v"),
        F.coalesce(anchors.cast("boolean"), F.lit(False)).alias("is_anchor"))
    kept = stored(kept.filter("vec_id is not null and label is not null"), shared_path(spark, "candidates"))
    width = max(1, kept.agg(F.max(F.size("v"))).first()[0] or 0)
    asked = kept.filter("is_anchor").select("vec_id", "label", "v").distinct()
    size = max(1, min(settings.block, _BLOCK_BYTES // (8 * width)))
    blocks = -(-asked.count() // size)
    out = shared_path(spark, "negatives")
    if blocks:
        # Dealt out in turn, so blocks differ by a few rows; the numbers are fixed once stored.
        asked = stored(asked.repartition(blocks).select(F.spark_partition_id().alias("block"), F.monotonically_increasing_id().alias("number"),
                                                        "vec_id", "label", "v"), shared_path(spark, "anchors"))
    for block in range(blocks):
        own = _Asked(asked.filter(F.col("block") == block).orderBy("number").toArrow(), width)
        _block(kept.select("vec_id", "label", "v"), own, settings).write.mode("overwrite").parquet(f"{out}/{block}")
    parts = [spark.read.schema(RESULT).parquet(f"{out}/{block}") for block in range(blocks)]
    return reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], RESULT)


def _block(rows: DataFrame, asked: _Asked, settings: Settings) -> DataFrame:
    sc = rows.sparkSession.sparkContext
    shared = sc.broadcast(asked)  # ``Settings.block`` anchors and _BLOCK_BYTES at most

    def positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value

        def same(k: int, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray):
            mine = (labels == own.labels[k]) & (ids != own.ids[k])
            if mine.any():
                yield k, settings.positives, scores[mine], ids[mine]

        best = own.against(batches, same)
        if best:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(list(best), [len(ids) for _, ids in best.values()]), pa.int32()),
                 pa.array(np.concatenate([ids for _, ids in best.values()])), pa.array(np.concatenate([x for x, _ in best.values()]))],
                names=["k", "positive_id", "positive_score"])

    place = Window.partitionBy("k").orderBy(F.desc("positive_score"), "positive_id")
    # At most ``positives`` rows for each anchor of the block.
    found = (rows.mapInArrow(positives, "k int, positive_id long, positive_score long").withColumn("positive_rank", F.row_number().over(place))
             .filter(F.col("positive_rank") <= settings.positives).orderBy("k", "positive_rank").toArrow())
    pairs: dict[int, list] = {}
    for k, positive, score, n in zip(*(found[c].to_pylist() for c in ("k", "positive_id", "positive_score", "positive_rank"))):
        pairs.setdefault(k, []).append((n, positive, score))
    windows = sc.broadcast(pairs)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
    names = ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score", "anchor_row", "positive_rank"]

    def negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, pairs = shared.value, windows.value

        def within(k: int, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray):
            other = labels != own.labels[k]
            for n, _, score in pairs.get(k, ()):
                near = other & (100 * scores <= settings.high * score) & (100 * scores >= settings.low * score)
                if near.any():
                    yield (k, n), settings.negatives, scores[near], ids[near]

        whole: list[tuple] = []  # at most ``negatives`` for each pair of the block
        for (k, n), (scores, ids) in own.against(batches, within).items():
            _, positive, score = pairs[k][n - 1]
            whole += [(int(own.ids[k]), positive, i, score, s, int(own.number[k]), n) for i, s in zip(ids.tolist(), scores.tolist())]
        if whole:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*whole), kinds)], names=names)

    place = Window.partitionBy("anchor_row", "positive_rank").orderBy(F.desc("negative_score"), "negative_id")
    schema = ", ".join(f"{n} {'int' if n == 'positive_rank' else 'long'}" for n in names)
    return (rows.mapInArrow(negatives, schema).withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= settings.negatives)
            .select(*[f.split()[0] for f in RESULT.split(", ")]))
