"""Connected components by alternating large-star and small-star joins.

Edges are a stored table between rounds; each round is two aggregates and joins, so a vertex with
very many neighbours is a partial minimum and a join that adaptive execution can split. Nothing
goes to the driver but a count and a checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivesearch.llm.shared import discard, shared_path, stored


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")),
                                          F.struct(F.col("v").alias("a"), F.col("u").alias("b")))).alias("e")
                        ).select("e.a", "e.b")


def _stars(sides: DataFrame, only_smaller: bool) -> DataFrame:
    """Of each vertex ``a``, the smallest of itself and its neighbours ``b`` takes over its larger
    neighbours (large star), or all of its smaller ones and itself (small star)."""
    least = sides.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = sides.join(least, "a")
    if only_smaller:  # every b is smaller than a here
        moved = joined.filter("b <> m").select(F.col("b").alias("u"), F.col("m").alias("v"))
        return moved.unionByName(least.select(F.col("a").alias("u"), F.col("m").alias("v"))).distinct()
    return joined.filter("b > a").select(F.col("b").alias("u"), F.col("m").alias("v")).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(vertex, component)`` of the vertices of ``edges(u, v)``: the smallest vertex reachable.

    Loops and repeated edges are harmless; rows with a null end are left out; no edges give no
    rows. Raises if the labels are not stable after ``max_rounds`` rounds.
    """
    spark = edges.sparkSession
    base = shared_path(spark, "components")
    now = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
                 f"{base}/0")
    mark = None
    for number in range(1, max_rounds + 1):
        large = _stars(_both(now), only_smaller=False)
        after = stored(_stars(large.select(F.col("u").alias("a"), F.col("v").alias("b")), only_smaller=True),
                       f"{base}/{number}")
        discard(spark, f"{base}/{number - 1}")
        row = after.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        now = after
        if (row.n, row.x) == mark:
            break
        mark = (row.n, row.x)
    else:
        raise RuntimeError(f"components are not stable after {max_rounds} rounds")
    return now.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct())
