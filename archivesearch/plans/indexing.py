"""Indexing chain (Q6): archive records -> page table -> inverted links -> page documents.

One lazy plan with two shuffles (link grouping, page/inlink join), as in the reference's
three chained jobs; the page table is written once because both later steps read it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from archivesearch.operators import extract as X
from archivesearch.operators import links as L
from archivesearch.operators.docs import join_inlinks, latest_per_key, page_documents
from archivesearch.sources.sinks import write_json, write_parquet


def index_pages(records: DataFrame, policy: str = "none", cfg: X.ExtractConfig = X.ExtractConfig(),
                collection: str | None = None, pages: DataFrame | None = None, keep: str = "latest") -> DataFrame:
    """Records -> exported page documents with anchors and inlink counts: one page per URL and
    time slice (A8), or every capture with ``keep="all"``."""
    pages = pages if pages is not None else X.build_page_data(records, cfg, collection)
    inlinks = L.invert_links(L.outlink_edges(pages), policy)
    return page_documents_of(pages, inlinks, policy, keep)


def page_documents_of(pages: DataFrame, inlinks: DataFrame, policy: str, keep: str) -> DataFrame:
    chosen = latest_per_key(pages, policy, keep).drop(*L.EDGE_KEY)
    return page_documents(join_inlinks(chosen, inlinks, policy))


def observed_documents(docs: DataFrame, observation: Observation) -> DataFrame:
    """A4: page documents, counted while they are written: ``docs_written``, those with inlinks, and the inlinks of all."""
    return docs.observe(observation, F.count(F.lit(1)).alias("docs_written"), F.count(F.when(F.col("inlinks") > 0, 1)).alias("docs_matched"),
                        F.coalesce(F.sum("inlinks"), F.lit(0)).alias("matched_inlinks"))


def write_counters(spark: SparkSession, observation: Observation, path: str) -> None:
    """The counters of a finished job as one line of JSON."""
    row = observation.get
    spark.createDataFrame([tuple(int(v) for v in row.values())], ", ".join(f"{k} long" for k in row)).coalesce(1).write.mode("overwrite").json(path)


def run_indexing(spark: SparkSession, records: DataFrame, out: str, policy: str = "none",
                 collection: str | None = None, cfg: X.ExtractConfig = X.ExtractConfig(), keep: str = "latest") -> None:
    """``pages`` -> ``links`` -> ``docs``: page table and inlinks as Parquet, docs as JSON lines."""
    write_parquet(X.build_page_data(records, cfg, collection), f"{out}/page_data")
    pages = spark.read.parquet(f"{out}/page_data")
    write_parquet(L.invert_links(L.outlink_edges(pages), policy), f"{out}/inlinks_data")
    docs = page_documents_of(pages, spark.read.parquet(f"{out}/inlinks_data"), policy, keep)
    write_json(docs, f"{out}/page_documents")
