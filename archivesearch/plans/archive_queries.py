"""Registered queries on archives: they write the driver's pages as WARC files and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from archivesearch.functions import hashes as H
from archivesearch.operators import extract as X
from archivesearch.plans import oracle as O
from archivesearch.plans.registry import register
from archivesearch.session import shared_path
from archivesearch.sources import tables as TB
from archivesearch.sources.archive import read_archive, write_archive

CFG = X.ExtractConfig()
SMALL_SPLIT = 1 << 16  # bytes of a range: several ranges even in the smallest archives


def _written(spark, records: DataFrame, **options) -> str:
    path = shared_path(spark, "archives")
    write_archive(records, path, **options)
    return path


def _pick_sql(values: list, index: str) -> str:
    return "([" + ", ".join("NULL" if v is None else O.q(v) for v in values) + f"])[{index} + 1]"


_TITLE = """replace(replace(replace(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&')"""
_LINKS = """len(regexp_extract_all(html, '(?:href|src)="([^"]+)"', 1))"""


@register("body_decoding", f"""SELECT page_id, CASE WHEN page_id % 7 < 5 THEN 'accepted' ELSE 'error' END AS disposition,
  CASE WHEN page_id % 7 < 5 THEN {_TITLE} END AS title, CASE WHEN page_id % 7 < 5 THEN {_LINKS} ELSE 0 END AS n_links, true AS digest_of_stored
FROM pages""")
def q_body_decoding(spark, d):
    """Plain, gzip, deflate and chunked bodies give the plain page; unknown and cut ones are errors; the digest is of the stored bytes."""
    records = read_archive(spark, _written(spark, TB.coded_records(spark, d)), accepted=CFG)
    records = records.withColumn("collection", H.payload_digest("payload"))  # carried beside, to compare
    out = X.extract_records(records)
    start = F.unix_timestamp(F.lit(TB.PAGES_EPOCH))
    page = ((F.unix_timestamp(F.to_timestamp("tstamp", "yyyyMMddHHmmss")) - start) / 3600).cast("long")
    return out.select(page.alias("page_id"), "disposition", F.col("raw_title").alias("title"), F.size("raw_links").cast("long").alias("n_links"),
                      (F.col("digest") == F.col("collection")).alias("digest_of_stored"))


@register("archive_ranges", """SELECT page_id, mode, upper(md5(html)) AS digest, octet_length(encode(html)) AS payload_bytes
FROM pages, (VALUES ('member for each record'), ('one member')) t(mode)""")
def q_archive_ranges(spark, d):
    """The same records from many byte ranges of an archive, and from archives that are single gzip members."""
    parts = []
    for mode, members in (("member for each record", "record"), ("one member", "file")):
        path = _written(spark, TB.page_records(spark, d), members=members)
        parts.append(read_archive(spark, path, splitBytes=SMALL_SPLIT).withColumn("mode", F.lit(mode)))
    return parts[0].unionByName(parts[1]).select(
        TB.page_of("record_date").alias("page_id"), "mode", H.payload_digest("payload").alias("digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"))


@register("archive_pushdown", f"""SELECT page_id, {_pick_sql(TB.RECORD_STATUSES, 'page_id % 6')} AS status,
  {_pick_sql(TB.RECORD_CONTENT_TYPES, '(page_id // 6) % 8')} AS content_type, octet_length(encode(html)) AS payload_bytes
FROM pages WHERE starts_with(status, '2') AND starts_with(content_type, 'text/html')""")
def q_archive_pushdown(spark, d):
    """The reader passes over the payloads of records that the filters refuse."""
    records = read_archive(spark, _written(spark, TB.page_records(spark, d)), splitBytes=SMALL_SPLIT)
    kept = records.filter("record_type = 'response' and status like '2%' and content_type like 'text/html%'")
    return kept.select(TB.page_of("record_date").alias("page_id"), "status", "content_type", F.octet_length("payload").cast("long").alias("payload_bytes"))


_ACCEPTED_SQL = f"""starts_with({_pick_sql(TB.RECORD_STATUSES, 'page_id % 6')}, '2')
  AND {_pick_sql(TB.RECORD_CONTENT_TYPES, '(page_id // 6) % 8')} NOT IN ('text/css', 'application/javascript', 'image/png', 'text/')"""


@register("archive_counters", f"""SELECT counter, CAST(value AS BIGINT) AS value FROM (
  UNPIVOT (SELECT count(*) AS records, count(*) FILTER ({_ACCEPTED_SQL}) AS accepted,
    count(*) FILTER (starts_with({_pick_sql(TB.RECORD_STATUSES, 'page_id % 6')}, '2') AND {_pick_sql(TB.RECORD_CONTENT_TYPES, '(page_id // 6) % 8')} = 'text/') AS error,
    count(*) FILTER (NOT ({_ACCEPTED_SQL}) AND NOT (starts_with({_pick_sql(TB.RECORD_STATUSES, 'page_id % 6')}, '2')
      AND {_pick_sql(TB.RECORD_CONTENT_TYPES, '(page_id // 6) % 8')} = 'text/')) AS discarded,
    0::BIGINT AS archive_errors FROM pages) ON COLUMNS(*) INTO NAME counter VALUE value)""")
def q_archive_counters(spark, d):
    """Records by disposition, counted while the page table is written; refused payloads never leave the reader."""
    records = read_archive(spark, _written(spark, TB.page_records(spark, d)), accepted=CFG)
    counters = Observation()
    X.build_page_data(records, CFG, observation=counters).write.parquet(shared_path(spark, "page_data"))
    return spark.createDataFrame([(k, int(v)) for k, v in counters.get.items()], "counter string, value long")


@register("archive_damage", """SELECT 'record' AS kind, page_id, upper(md5(html)) AS digest, 1 AS n FROM pages WHERE page_id % 10 NOT IN (3, 5, 7)
UNION ALL SELECT 'error', NULL, NULL, count(*) FROM pages WHERE page_id % 10 IN (3, 5, 7) HAVING count(*) > 0""")
def q_archive_damage(spark, d):
    """Every undamaged record is read, and each damage is one error row, also over many ranges."""
    path = _written(spark, TB.damaged_members(spark, d))
    records = read_archive(spark, path, splitBytes=SMALL_SPLIT, maxErrors=1 << 30).select(
        F.when(F.col("error").isNull(), F.lit("record")).otherwise(F.lit("error")).alias("kind"),
        TB.page_of("record_date").alias("page_id"), H.payload_digest("payload").alias("digest"))
    return records.groupBy("kind", "page_id", "digest").agg(F.count(F.lit(1)).alias("n"))


_ENCODING_SQL = """CASE WHEN page_id % 8 = 4 THEN 'utf-16-le' WHEN page_id % 8 IN (1, 2, 3) AND regexp_matches(html, '[^\\x00-\\x7F]') THEN 'windows-1252' ELSE 'utf-8' END"""


@register("charset_and_type", f"""SELECT page_id, {_ENCODING_SQL} AS encoding, 'text/html' AS detected_type,
  split_part({_pick_sql([t for *_, t in TB.WRITINGS], 'page_id % 8')}, ';', 1) AS type, {_TITLE} AS title, {_LINKS} AS outlinks FROM pages""")
def q_charset_and_type(spark, d):
    """Pages in other character sets and under wrong types: read in the right set, parsed as HTML, the served type kept beside."""
    records = read_archive(spark, _written(spark, TB.written_records(spark, d)), accepted=CFG)
    pages = X.build_page_data(records, CFG)
    start = F.unix_timestamp(F.lit(TB.PAGES_EPOCH))
    page = ((F.unix_timestamp(F.to_timestamp("tstamp", "yyyyMMddHHmmss")) - start) / 3600).cast("long")
    return pages.select(page.alias("page_id"), "encoding", "detected_type", "type", "title", F.col("outlinks").cast("long").alias("outlinks"))
