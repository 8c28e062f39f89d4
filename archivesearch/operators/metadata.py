"""Point lookups by ``url/timestamp`` ids: exact version, extracted text, metadata merge
(P20, J2, J5, J6, U2, U3).

All lookups are equi-joins of a request table with documents exploded to their versions
(``surt``, ``tstamp``), never per-id loops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivesearch.functions import timestamps as TS
from archivesearch.functions import urls as U
from archivesearch.functions._util import col_of
from archivesearch.operators import captures as C

ID_RE = r"^(.+)/([^/]*)$"


def split_id(id_col) -> tuple[Column, Column, Column]:
    """P20: split at the last ``/``; valid when the URL part looks like a URL and the time
    part is all digits (and the split index is > 0)."""
    c = col_of(id_col)
    url = F.regexp_extract(c, ID_RE, 1)
    ts = F.regexp_extract(c, ID_RE, 2)
    valid = c.rlike(ID_RE) & U.is_url(url) & ts.rlike(r"^[0-9]+$")
    return url, ts, valid


def parse_requests(requests: DataFrame, id_col: str = "id") -> DataFrame:
    url, ts, valid = split_id(id_col)
    return requests.select("*", url.alias("req_url"), ts.alias("req_ts"), valid.alias("valid"))


def version_lookup(requests: DataFrame, versions: DataFrame) -> DataFrame:
    """J6 + U2 (Q5): requests ``(req_id, urls, tstamp)``; ``urls`` is a comma list (OR).

    Invalid URLs are dropped; the time is canonicalised (F8). One row per matching
    ``(req_id, doc_id)``.
    """
    r = (requests.select("req_id", F.explode(F.split("urls", ",")).alias("u"), "tstamp")
         .filter(U.is_url("u"))
         .select("req_id", U.surt("u").alias("surt"), TS.canonical_timestamp("tstamp").alias("tstamp")))
    found = versions.withColumnRenamed("collection", "vcollection").join(r, ["surt", "tstamp"])
    one = F.min(F.struct("surt", "tstamp", "vcollection")).alias("v")
    return found.groupBy("req_id", "doc_id").agg(one).select("req_id", "doc_id", "v.*")


def extracted_text(requests: DataFrame, docs: DataFrame, versions: DataFrame) -> DataFrame:
    """J5 (Q4): per ``req_id, id`` -> ``title + ", " + content`` of the document holding that
    version; ``found = false`` when none (the 404 of the reference)."""
    p = parse_requests(requests)
    hits = version_lookup(p.filter("valid").select("req_id", F.col("req_url").alias("urls"),
                                                  F.col("req_ts").alias("tstamp")), versions)
    first = hits.groupBy("req_id").agg(F.min("doc_id").alias("doc_id"))
    text = docs.select(F.col("id").alias("doc_id"),
                       F.concat_ws(", ", F.coalesce("titleString", F.lit("")), F.coalesce("content", F.lit(""))).alias("text"))
    found = first.join(text, "doc_id")
    return (p.select("req_id").join(found, "req_id", "left")
            .select("req_id", F.col("doc_id").isNotNull().alias("found"), "doc_id", "text"))


def metadata(requests: DataFrame, docs: DataFrame, versions: DataFrame, captures: DataFrame) -> DataFrame:
    """J2 + U3 (Q3): text hit merged with the capture of the same ``(url, timestamp)``.

    The capture wins for status, length, offset, file name and digest, and for the
    collection when non-empty; without a text hit the capture row alone is returned.
    Versions and captures are united by their key ``(surt, tstamp)`` first, so the requests
    are joined once.
    """
    p = parse_requests(requests).filter("valid").select(
        "req_id", U.surt("req_url").alias("surt"), TS.canonical_timestamp("req_ts").alias("tstamp"))
    text = versions.select("surt", "tstamp", F.struct("doc_id", F.col("collection").alias("vcollection")).alias("t"))
    text = text.groupBy("surt", "tstamp").agg(F.min("t").alias("t"))
    cdx = C.typed(captures).withColumn("surt", U.surt("url")).groupBy("surt", F.col("timestamp").alias("tstamp")).agg(
        F.min(F.struct("digest", "offset_long", "statusCode", "contentLength", "filename", "collection", "mime")).alias("c"))
    both = (text.withColumn("c", F.lit(None).cast(cdx.schema["c"].dataType))
            .unionByName(cdx.withColumn("t", F.lit(None).cast(text.schema["t"].dataType)))
            .groupBy("surt", "tstamp").agg(F.max("t").alias("t"), F.max("c").alias("c")))
    j = p.join(both, ["surt", "tstamp"]).join(
        docs.select(F.col("id").alias("t_id"), F.col("titleString").alias("t_title"), F.col("type").alias("t_type")),
        F.col("t.doc_id") == F.col("t_id"), "left")
    has_t, has_c = F.col("t").isNotNull(), F.col("c").isNotNull()
    return j.select(
        "req_id",
        has_t.alias("found_text"), has_c.alias("found_cdx"),
        F.when(has_t, F.col("t_title")).otherwise(F.lit(None).cast("string")).alias("title"),
        F.when(has_t, F.col("t_type")).otherwise(F.col("c.mime")).alias("mimeType"),
        F.when(has_t & has_c & (F.coalesce(F.col("c.collection"), F.lit("")) != ""), F.col("c.collection"))
        .when(has_t, F.col("t.vcollection")).otherwise(F.col("c.collection")).alias("collection"),
        F.col("c.statusCode").alias("statusCode"),
        F.col("c.contentLength").alias("contentLength"),
        F.col("c.offset_long").alias("offset"),
        F.col("c.filename").alias("fileName"),
        F.when(has_c, F.col("c.digest")).otherwise(F.col("t.doc_id")).alias("digest"),
    )
