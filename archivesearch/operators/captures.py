"""Capture (CDX) lists: completeness, identity, URL history, closest capture.

Requests are rows too, so a batch of URL lookups is one equi-join on the SURT key followed by
aggregates and windows per request; adaptive execution broadcasts a small batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivesearch.functions import urls as U
from archivesearch.functions._util import col_of

CDX_FIELDS = ["url", "timestamp", "digest", "mime", "status", "filename", "length", "offset"]


def cdx_schema() -> str:
    """All fields are strings, as served."""
    return ", ".join(f"`{c}` string" for c in CDX_FIELDS + ["collection"])


def read_cdx(spark, path: str) -> DataFrame:
    """JSON lines, one capture per line, with a fixed schema (no inference)."""
    return spark.read.schema(cdx_schema()).json(path)


def is_complete(df: DataFrame) -> Column:
    """The eight CDX fields (not the collection) are non-null and non-empty."""
    cond = F.lit(True)
    for c in CDX_FIELDS:
        cond = cond & F.col(c).isNotNull() & (F.col(c) != "")
    return cond


def typed(df: DataFrame) -> DataFrame:
    """Numbers parsed on use; null/unparsable length and status stay null."""
    return df.withColumns({
        "contentLength": F.expr("try_cast(`length` AS BIGINT)"),
        "offset_long": F.expr("try_cast(`offset` AS BIGINT)"),
        "statusCode": F.expr("try_cast(`status` AS INT)"),
    })


def distinct_captures(captures: DataFrame) -> DataFrame:
    """One row per capture identity ``(digest, timestamp)``, with its number of copies."""
    return captures.groupBy("digest", "timestamp").agg(F.count(F.lit(1)).alias("copies"))


def cdx_bound(b, pad: str) -> Column:
    """Query bound of the capture list: empty/null = unbounded; digits padded to 14."""
    c = col_of(b)
    return F.when(c.isNull() | (c == ""), F.lit(None).cast("string")).otherwise(
        F.rpad(F.substring(c, 1, 14), 14, pad))


def version_history(requests: DataFrame, captures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """T5 + P19 (Q2): captures of each requested URL, newest first, sliced ``[start, start+limit)``.

    ``requests``: ``req_id, url, from, to, start, limit``; a null ``limit`` asks for all. Returns
    ``(rows, totals)``; totals count every match. If every request has a limit, the window gets
    the deepest slice of the batch as a constant bound, so a URL with very many captures is cut
    map-side before the shuffle.
    """
    req = U.with_surt(requests, "url", "surt").select(
                          "req_id", "surt", cdx_bound(F.col("from"), "0").alias("lo"), cdx_bound(F.col("to"), "9").alias("hi"),
                          F.coalesce("start", F.lit(0)).alias("start"), "limit")
    caps = U.with_surt(captures, "url", "surt")
    m = caps.join(req, "surt").filter(
        (F.col("lo").isNull() | (F.col("timestamp") >= F.col("lo")))
        & (F.col("hi").isNull() | (F.col("timestamp") <= F.col("hi"))))
    totals = m.groupBy("req_id").agg(F.count(F.lit(1)).alias("total"))
    end = F.coalesce("start", F.lit(0)).cast("long") + F.col("limit")
    depth, unbounded = requests.agg(F.max(end), F.max(F.col("limit").isNull())).first()
    w = Window.partitionBy("req_id").orderBy(F.desc("timestamp"), F.asc("digest"), F.asc("offset"))
    ranked = m.withColumn("pos", F.row_number().over(w))
    if not unbounded:
        ranked = ranked.filter(F.col("pos") <= F.lit(int(depth or 0)))
    rows = ranked.filter((F.col("pos") > F.col("start")) & (
        F.col("limit").isNull() | (F.col("pos") <= F.col("start").cast("long") + F.col("limit"))))
    return rows, totals


def closest_capture(requests: DataFrame, captures: DataFrame) -> DataFrame:
    """Per request ``(req_id, url, tstamp)``, the capture of that URL nearest in time.

    Ties go to the earlier capture, then the smaller digest. One partial minimum per request,
    not a sort of all captures of a URL. Times are compared by their digit fields, so days that
    no calendar has (30 February, which canonical times may hold) count on from their month.
    """
    req = U.with_surt(requests, "url", "surt").select("req_id", "surt", F.col("tstamp").alias("target"))
    caps = U.with_surt(captures, "url", "surt")
    j = caps.join(req, "surt").withColumn("diff_seconds", F.abs(seconds("target") - seconds("timestamp")))
    best = F.min(F.struct("diff_seconds", "timestamp", "digest", "url"))
    return (j.filter("diff_seconds is not null").groupBy("req_id").agg(best.alias("b"))
            .select("req_id", "b.timestamp", "b.digest", "b.url", "b.diff_seconds"))


def seconds(t) -> Column:
    """Seconds of a 14-digit time from its fields: whole days to the first of its month, then
    days, hours, minutes and seconds as they stand. Null if the month is none."""
    c = col_of(t)
    field = lambda at, n: F.substring(c, at, n).try_cast("int")
    year, month = field(1, 4), field(5, 2)
    first = F.when(month.between(1, 12) & year.between(1, 9999), F.make_date(year, month, F.lit(1)))
    days = F.unix_date(first).cast("long") + field(7, 2) - 1
    return ((days * 24 + field(9, 2)) * 60 + field(11, 2)) * 60 + field(13, 2)


def expand_url_requests(requests: DataFrame, url: str = "url") -> DataFrame:
    """One request row per http/https variant of its URL."""
    return requests.withColumn(url, F.explode(U.expand_url_variants(url)))
