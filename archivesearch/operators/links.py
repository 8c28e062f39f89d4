"""Link graph: outlink edges, inversion, anchor text, inlink counts, edge merge.

Edges are rows, never per-URL sets held in memory: every step is a DataFrame
dedup/aggregate with map-side partial aggregation, so a popular target is reduced
before its rows meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivesearch.functions import urls as U
from archivesearch.functions.timestamps import time_slice

EDGE_KEY = ["surt", "time_slice"]


def outlink_edges(pages: DataFrame) -> DataFrame:
    """Page rows with ``out_links`` -> one row per link ``(from_url, to_url, anchor, tstamp)``."""
    return (pages.select(F.col("url").alias("from_url"), "tstamp", F.explode("out_links").alias("l"))
            .select("from_url", F.col("l.to_url").alias("to_url"),
                    F.coalesce(F.col("l.anchor"), F.lit("")).alias("anchor"), "tstamp"))


def invert_links(edges: DataFrame, policy: str = "none") -> DataFrame:
    """A1: key each edge by ``(surt(to_url), time slice of the source capture)``; set semantics.

    Output: one row per distinct ``(surt, time_slice, from_url, anchor)``. Self-links are kept.
    """
    rows = edges.select("to_url", time_slice("tstamp", policy).alias("time_slice"), "from_url",
                        F.coalesce("anchor", F.lit("")).alias("anchor"))
    keyed = U.with_surt(rows, "to_url", "surt").drop("to_url")
    return keyed.filter(F.col("surt").isNotNull()).dropDuplicates(EDGE_KEY + ["from_url", "anchor"])


def inlink_counts(inlinks: DataFrame) -> DataFrame:
    """A3: number of distinct ``(from_url, anchor)`` per key, empty anchors included."""
    return inlinks.groupBy(*EDGE_KEY).agg(F.count(F.lit(1)).cast("int").alias("inlinks"))


def anchors(inlinks: DataFrame) -> DataFrame:
    """A2 as rows: each non-empty anchor once per key and source host, ``(surt, time_slice,
    anchor, host)``. A popular target is many rows, spread by all four columns."""
    return (inlinks.filter(F.col("anchor") != "")
            .select(*EDGE_KEY, "anchor", U.url_host("from_url").alias("host")).distinct())


def anchor_text(inlinks: DataFrame) -> DataFrame:
    """A2 as exported: the anchors of a key sorted by (anchor, host), each followed by one space.

    The string holds every anchor, so its size is that of the key's anchors; only the page
    export asks for it, everything else works on ``anchors``.
    """
    listed = anchors(inlinks).groupBy(*EDGE_KEY).agg(F.array_sort(F.collect_list(F.struct("anchor", "host"))).alias("pairs"))
    return listed.select(*EDGE_KEY, _anchor_string("pairs").alias("anchor"), F.size("pairs").alias("anchor_count"))


def _anchor_string(pairs: str) -> Column:
    return F.concat(F.array_join(f"{pairs}.anchor", " "), F.lit(" "))


def inlink_summary(inlinks: DataFrame) -> DataFrame:
    """A2 + A3 per key: ``(surt, time_slice, anchor, inlinks)``; keys without anchors get ``''``.

    One aggregate reads the edges once; a task sends on the count and the distinct anchors of a key, whatever its edges.
    """
    pair = F.struct("anchor", U.url_host("from_url").alias("host"))
    both = inlinks.groupBy(*EDGE_KEY).agg(
        F.count(F.lit(1)).cast("int").alias("inlinks"), F.collect_set(F.when(F.col("anchor") != "", pair)).alias("pairs"))
    both = both.withColumn("pairs", F.array_sort(F.array_distinct("pairs")))
    return both.select(*EDGE_KEY, F.when(F.size("pairs") > 0, _anchor_string("pairs")).otherwise(F.lit("")).alias("anchor"), "inlinks")


def merge_edges(a: DataFrame, b: DataFrame) -> DataFrame:
    """U4: set union of two inverted edge tables (e.g. append a new crawl)."""
    cols = EDGE_KEY + ["from_url", "anchor"]
    return a.select(*cols).unionByName(b.select(*cols)).dropDuplicates(cols)
