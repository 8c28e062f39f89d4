"""Page documents and version documents.

``join_inlinks`` builds the one-JSON-per-page export of the indexer; ``version_docs``
folds repeated captures of the same content into one searchable document, and
``document_versions`` keeps its captures as rows: a content captured millions of times (an
empty page, an error page) is millions of rows there, never one array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivesearch.functions.timestamps import solr_date, time_slice
from archivesearch.operators.links import EDGE_KEY, inlink_summary

# Names and order of the exported page document (S7); transient fields are not exported.
PAGE_DOC_FIELDS = ["id", "title", "anchor", "collection", "content", "content_length", "digest",
                   "tstamp", "site", "url", "surt_url", "inlinks", "outlinks", "type",
                   "primary_type", "sub_type", "encoding", "warc_name", "warc_offset"]
PAGE_ORDER = ["tstamp", "warc_name", "warc_offset"]
# The one order of versions, used wherever the oldest is asked for.
VERSION_ORDER = ["tstamp", "collection", "surt"]


def latest_per_key(pages: DataFrame, policy: str = "none", keep: str = "latest",
                   surt_col: str = "surt_url", captures: str | None = None) -> DataFrame:
    """One page per ``(surt, time_slice)``: the max ``(tstamp, warc_name, warc_offset)``.

    The aggregate carries only that key (partial on the map side); the one page is joined
    back by it, on all key columns, so a URL captured very many times spreads. Pages without any other
    column are the aggregate itself. ``captures`` names a column for the number of pages of a key, counted by the way.
    ``keep="all"`` returns every page with its key.
    """
    keyed = pages.withColumn("surt", F.col(surt_col)).withColumn("time_slice", time_slice("tstamp", policy))
    if keep == "all":
        return keyed
    if keep != "latest":
        raise ValueError("keep must be 'latest' or 'all'")
    on = EDGE_KEY + PAGE_ORDER
    count = [F.count(F.lit(1)).alias(captures)] if captures else []
    best = keyed.groupBy(*EDGE_KEY).agg(F.max(F.struct(*PAGE_ORDER)).alias("k"), *count)
    best = best.select(*EDGE_KEY, "k.*", *[captures] * len(count))
    if set(keyed.columns) <= {surt_col, *on}:
        return best.withColumn(surt_col, F.col("surt")).select(*keyed.columns, *[captures] * len(count))
    if not captures:
        matches = [keyed[c].eqNullSafe(best[c]) for c in on]
        return keyed.join(best, matches, "left_semi").dropDuplicates(on)
    best = best.select(*[F.col(c).alias(f"best_{i}") for i, c in enumerate(on)], captures)
    matches = [F.col(c).eqNullSafe(F.col(f"best_{i}")) for i, c in enumerate(on)]
    return keyed.join(best, matches).drop(*[f"best_{i}" for i in range(len(on))]).dropDuplicates(on)


def join_inlinks(pages: DataFrame, inlinks: DataFrame, policy: str = "none",
                 surt_col: str = "surt_url") -> DataFrame:
    """Pages left-joined to their inlink anchors and counts on ``(surt, time_slice)``.

    Inlinks whose target was never captured are dropped (left join from pages). Several
    pages of one key (``latest_per_key`` with ``keep="all"``) share the key's anchors.
    """
    summary = inlink_summary(inlinks)
    keyed = pages.withColumn("surt", F.col(surt_col)).withColumn("time_slice", time_slice("tstamp", policy))
    drop = [c for c in ("anchor", "inlinks") if c in keyed.columns]
    joined = keyed.drop(*drop).join(summary, EDGE_KEY, "left")
    return joined.withColumns({
        "anchor": F.coalesce("anchor", F.lit("")),
        "inlinks": F.coalesce("inlinks", F.lit(0)),
    })


def page_documents(pages_with_inlinks: DataFrame) -> DataFrame:
    """The exported search document columns, in their JSON names."""
    return pages_with_inlinks.select(*[c for c in PAGE_DOC_FIELDS if c in pages_with_inlinks.columns])


def document_versions(captures: DataFrame) -> DataFrame:
    """The distinct versions of each document as rows ``(doc_id, collection, tstamp, surt)``."""
    return captures.select(F.col("digest").alias("doc_id"), "collection", "tstamp", "surt").distinct()


def version_docs(captures: DataFrame) -> DataFrame:
    """Captures grouped by content digest into one document each.

    Input columns: ``digest, url, surt, tstamp, collection, title, content, type``. The
    document shows its oldest capture, the min of ``VERSION_ORDER`` (then url, type). Only
    that key is aggregated; the row with the texts is joined back by all of it, so a digest
    with very many captures spreads over tasks.
    """
    c = captures.select("digest", "url", "surt", "tstamp", "collection", "title", "content", "type")
    order = [*VERSION_ORDER, "url", "type"]
    head = c.groupBy("digest").agg(
        F.min(F.struct(*order)).alias("o"), F.max("tstamp").alias("tstampLatest"),
        F.count(F.lit(1)).alias("captures")).select("digest", "o.*", "tstampLatest", "captures")
    on = ["digest", *order]
    one = c.join(head, on).dropDuplicates(on)
    return one.select(
        F.col("digest").alias("id"),
        "title",
        F.col("title").alias("titleString"),
        "content", "type",
        F.col("tstamp").alias("tstampOldest"), "tstampLatest",
        solr_date("tstamp").alias("dateOldest"),
        solr_date("tstampLatest").alias("dateLatest"),
        F.col("surt").alias("surtOldest"),
        F.col("collection").alias("collectionOldest"),
        "collection",
        F.col("url").alias("urlOldest"),
        "captures",
    )


def oldest_version(versions: DataFrame, by: list[str]) -> DataFrame:
    """The smallest ``(tstamp, collection, surt)`` of each group of version rows, as a
    struct ``oldest``; a partial minimum, so long histories are reduced on the map side."""
    return versions.groupBy(*by).agg(F.min(F.struct(*VERSION_ORDER)).alias("oldest"))


def version_strings(versions: DataFrame, by: str = "doc_id") -> DataFrame:
    """Export form of a document's versions: sorted ``collection/tstamp/surt`` words in one
    string. Only the export needs it; operators work on the rows."""
    word = F.concat_ws("/", "collection", "tstamp", "surt")
    return versions.groupBy(by).agg(F.array_join(F.array_sort(F.collect_list(word)), " ").alias("versions"))
