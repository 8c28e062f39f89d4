"""Archive-shaped tables derived from the driver's parquet tables.

Every derivation is a narrow projection of one input table (no shuffle), so the derived
tables grow with their inputs and keep their partitioning. The DuckDB oracle mirrors
each derivation in ``archivesearch/oracle.py``; keep the two in step.
"""

from __future__ import annotations

import gzip
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archivesearch.functions import urls as U
from archivesearch.functions.timestamps import ts14

# Fixed values of the derivations.
PAGES_EPOCH = "2024-01-01 00:00:00"       # page capture time = epoch + page_id hours
DOCS_EPOCH = "2015-01-01 00:00:00"        # document capture time = epoch + doc_id * 437 minutes
PARTS_EPOCH = "1995-01-01 00:00:00"       # part page capture time = epoch + partkey * 7 hours
DOC_TYPES = ["text/html", "text/html", "text/plain", "application/pdf", "application/msword"]
RECORD_STATUSES = ["200", "200", "301", "404", "206", "500"]
RECORD_CONTENT_TYPES = ["text/html; charset=utf-8", "text/plain", "application/pdf", "text/css",
                        "application/javascript", "image/png", "TEXT/HTML", "text/"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ts_plus(epoch: str, unit: str, amount: Column) -> Column:
    return F.timestamp_add(unit, amount, F.lit(epoch).cast("timestamp_ntz"))


def _pick(values: list[str], index: Column) -> Column:
    """``values[index]`` (0-based) as a Column."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def captured_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured HTML pages: one response record per row of ``pages``."""
    p = read_table(spark, sf_dir, "pages")
    return p.select(
        "page_id", "url", "html",
        ts14(_ts_plus(PAGES_EPOCH, "HOUR", F.col("page_id"))).alias("tstamp"),
        F.concat(F.lit("col"), (F.col("page_id") % 3).cast("string")).alias("collection"),
        F.lit("text/html; charset=utf-8").alias("content_type"),
        F.lit("200").alias("status"),
        F.lit("response").alias("record_type"),
        F.concat(F.lit("pages-"), (F.col("page_id") % 4).cast("string"), F.lit(".warc.gz")).alias("warc_name"),
        (F.col("page_id") * 4096).alias("warc_offset"),
    )


def archive_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record envelopes (type, URL, status, content type) with every disposition case."""
    e = read_table(spark, sf_dir, "events")
    rec_type = (F.when(F.col("event_type").isin("view", "click"), F.lit("response"))
                .when(F.col("event_type") == "purchase", F.lit("revisit"))
                .when(F.col("event_type") == "signup", F.lit("request")))
    site_url = F.concat(F.lit("http://www.site"), (F.col("user_id") % 7).cast("string"),
                        F.lit(".example.pt/u/"), F.col("user_id").cast("string"))
    url = (F.when(F.col("event_id") % 50 == 0, F.lit(None).cast("string"))
           .when(F.col("event_id") % 50 == 1,
                 F.concat(F.lit("ftp://files.example.pt/u/"), F.col("user_id").cast("string")))
           .otherwise(site_url))
    status = F.when(F.col("event_id") % 40 == 3, F.lit(None).cast("string")).otherwise(
        _pick(RECORD_STATUSES, F.floor("value").cast("bigint") % 6))
    ctype = F.when(F.col("event_id") % 9 == 4, F.lit(None).cast("string")).otherwise(
        _pick(RECORD_CONTENT_TYPES, F.col("event_id") % 8))
    return e.select(
        F.col("event_id").alias("record_id"),
        rec_type.alias("record_type"), url.alias("url"), status.alias("status"),
        ctype.alias("content_type"), ts14("ts").alias("tstamp"))


def link_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlink edges ``(from_url, to_url, anchor, tstamp)``, one per ``lineitem`` row; pages of
    every third order were crawled again a week later, with the same links."""
    li = read_table(spark, sf_dir, "lineitem")
    week = F.expr("l_shipdate + interval 7 days")
    li = li.unionByName(li.filter("l_orderkey % 3 = 0").withColumn("l_shipdate", week))
    return li.select(
        F.concat(F.lit("http://s"), F.col("l_suppkey").cast("string"), F.lit(".example.com/o/"),
                 F.col("l_orderkey").cast("string")).alias("from_url"),
        F.concat(F.lit("http://www.example.com/p/"), F.col("l_partkey").cast("string"),
                 F.lit("/")).alias("to_url"),
        F.when(F.col("l_linenumber") == 1, F.lit(""))
        .otherwise(F.concat("l_returnflag", "l_linestatus")).alias("anchor"),
        ts14("l_shipdate").alias("tstamp"),
        F.concat(F.lit("li-"), (F.col("l_orderkey") % 16).cast("string"), F.lit(".warc.gz")).alias("warc_name"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("warc_offset"),
    )


def part_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link-target pages: one page per part, titled with the part name."""
    p = read_table(spark, sf_dir, "part")
    url = F.concat(F.lit("http://example.com/p/"), F.col("p_partkey").cast("string"))
    return p.select(
        F.col("p_partkey").alias("page_key"),
        url.alias("url"),
        U.surt(url).alias("surt"),
        F.col("p_name").alias("title"),
        ts14(_ts_plus(PARTS_EPOCH, "HOUR", F.col("p_partkey") * 7)).alias("tstamp"),
        F.concat(F.lit("col"), (F.col("p_partkey") % 3).cast("string")).alias("collection"),
    )


def cdx_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CDX capture rows (all strings, as served), one per ``events`` row."""
    e = read_table(spark, sf_dir, "events")
    mime = (F.when(F.col("event_type").isin("view", "click"), F.lit("text/html"))
            .when(F.col("event_type") == "purchase", F.lit("application/pdf"))
            .when(F.col("event_type") == "signup", F.lit("text/plain"))
            .otherwise(F.lit("image/png")))
    status = F.when(F.col("event_type") == "error", F.lit(None).cast("string")).otherwise(
        (F.lit(200) + F.lit(100) * (F.floor("value").cast("bigint") % 4)).cast("string"))
    length = F.when(F.col("event_id") % 25 == 0, F.lit(None).cast("string")).otherwise(
        (F.length("props") * 97).cast("string"))
    collection = F.when(F.col("user_id") % 5 == 0, F.lit("")).otherwise(
        F.concat(F.lit("col"), (F.col("user_id") % 3).cast("string")))
    return e.select(
        F.concat(F.lit("http://www.site"), (F.col("user_id") % 7).cast("string"),
                 F.lit(".example.pt/u/"), F.col("user_id").cast("string")).alias("url"),
        ts14("ts").alias("timestamp"),
        F.upper(F.md5("props")).alias("digest"),
        mime.alias("mime"),
        status.alias("status"),
        F.concat(F.lit("EV-"), F.date_format("ts", "yyyyMMdd"), F.lit(".warc.gz")).alias("filename"),
        length.alias("length"),
        (F.col("event_id") * 1000).cast("string").alias("offset"),
        collection.alias("collection"),
    )


def document_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured text documents: one capture per ``documents`` row (exact copies share a digest)."""
    d = read_table(spark, sf_dir, "documents")
    url = F.concat(F.lit("http://www."), F.col("source"), F.lit(".example.org/d/"),
                   F.col("doc_id").cast("string"))
    return d.select(
        "doc_id",
        url.alias("url"),
        U.surt(url).alias("surt"),
        F.col("source").alias("site"),
        F.split_part(F.col("text"), F.lit("\n"), F.lit(1)).alias("title"),
        F.col("text").alias("content"),
        F.upper(F.md5("text")).alias("digest"),
        ts14(_ts_plus(DOCS_EPOCH, "MINUTE", F.col("doc_id") * 437)).alias("tstamp"),
        F.concat(F.lit("col"), (F.col("doc_id") % 3).cast("string")).alias("collection"),
        _pick(DOC_TYPES, F.col("doc_id") % 5).alias("type"),
        "lang",
    )


# ------------------------------------------------------------------ archives written from the pages

def _record_date(n: Column) -> Column:
    """WARC-Date of page ``n``: an hour for each, so that a record tells its page."""
    return F.date_format(_ts_plus(PAGES_EPOCH, "HOUR", n), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def page_of(record_date) -> Column:
    """The page_id behind a ``record_date`` of the archives written here."""
    start = F.unix_timestamp(F.lit(PAGES_EPOCH))
    return ((F.unix_timestamp(F.to_timestamp(record_date, "yyyy-MM-dd'T'HH:mm:ss'Z'")) - start) / 3600).cast("long")


def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` as records to be written: every status and content type of ``archive_records`` occurs."""
    p = read_table(spark, sf_dir, "pages")
    return p.select(
        F.lit("response").alias("record_type"), "url", _record_date(F.col("page_id")).alias("record_date"),
        _pick(RECORD_STATUSES, F.col("page_id") % 6).alias("status"),
        _pick(RECORD_CONTENT_TYPES, F.floor(F.col("page_id") / 6) % 8).alias("content_type"),
        F.lit(None).cast("map<string,string>").alias("headers"), F.col("html").cast("binary").alias("payload"))


#: Body codings by page_id % 7: transfer and content coding as served; the last two are an unknown coding and a cut gzip body.
CODINGS = [(None, None), (None, "gzip"), (None, "deflate"), ("chunked", None), ("chunked", "x-gzip"), (None, "compress"), (None, "gzip")]


def coded_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` as records whose bodies are coded by ``CODINGS``."""

    @F.pandas_udf("binary")
    def coded(html, kind):
        def one(text: str, k: int) -> bytes:
            data = text.encode("utf-8")
            if k in (1, 4, 6):
                data = gzip.compress(data, mtime=0)
            if k == 2:
                data = zlib.compress(data)
            if k in (3, 4):
                parts = [data[a:a + 1000] for a in range(0, len(data), 1000)]
                data = b"".join(b"%x\r\n%s\r\n" % (len(x), x) for x in parts) + b"0\r\n\r\n"
            return data[:len(data) // 2] if k == 6 else data

        return html.combine(kind, one)

    kind = (F.col("page_id") % 7).cast("int")
    head = F.map_filter(F.create_map(
        F.lit("transfer-encoding"), _pick([t for t, _ in CODINGS], kind),
        F.lit("content-encoding"), _pick([c for _, c in CODINGS], kind)), lambda k, v: v.isNotNull())
    p = read_table(spark, sf_dir, "pages").select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    return p.select(
        F.lit("response").alias("record_type"), "url", _record_date(F.col("page_id")).alias("record_date"), F.lit("200").alias("status"),
        F.lit("text/html; charset=utf-8").alias("content_type"), head.alias("headers"), coded("html", kind).alias("payload"))


#: Character sets and served types by page_id % 8: set of the bytes, set that the page's meta names, served content type.
WRITINGS = [("utf-8", None, "text/html"), ("windows-1252", None, "text/html; charset=ISO-8859-1"), ("windows-1252", "windows-1252", "text/html"),
            ("windows-1252", None, "text/html"), ("utf-16", None, "text/html"), ("utf-8", None, "text/html; charset=iso-8859-1"),
            ("utf-8", None, "text/plain"), ("utf-8", None, "application/pdf")]


def written_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` as records in the sets and under the types of ``WRITINGS``."""

    @F.pandas_udf("binary")
    def written(html, kind):
        def one(text: str, k: int) -> bytes:
            charset, named, _ = WRITINGS[k]
            meta = f'<meta charset="{named}">' if named else ""
            return text.replace('<meta charset="utf-8">', meta).encode(charset, "xmlcharrefreplace")

        return html.combine(kind, one)

    kind = (F.col("page_id") % 8).cast("int")
    p = read_table(spark, sf_dir, "pages").select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    return p.select(
        F.lit("response").alias("record_type"), "url", _record_date(F.col("page_id")).alias("record_date"), F.lit("200").alias("status"),
        _pick([t for *_, t in WRITINGS], kind).alias("content_type"), written("html", kind).alias("payload"))


def damaged_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` as gzip members (column ``raw``), of which three in ten are damaged: page_id % 10 of 3 has a Content-Length that is no number, 5 a
    changed byte within its compression, 7 ends within its head."""

    @F.pandas_udf("binary")
    def member(url, date, html, kind):
        out = []
        for u, d, h, k in zip(url, date, html, kind):
            body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + h.encode("utf-8")
            length = "many" if k == 3 else str(len(body))
            head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: {u}\r\nWARC-Date: {d}\r\nContent-Length: {length}\r\n"
            data = head.encode("utf-8") + (b"" if k == 7 else b"\r\n" + body + b"\r\n\r\n")
            packed = bytearray(gzip.compress(data, mtime=0))
            if k == 5:
                packed[len(packed) // 2] ^= 0x55
            out.append(bytes(packed))
        return pd.Series(out)

    p = read_table(spark, sf_dir, "pages").select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    return p.select(member("url", _record_date(F.col("page_id")), "html", (F.col("page_id") % 10).cast("int")).alias("raw"))
