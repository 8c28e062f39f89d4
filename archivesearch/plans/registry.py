"""Registered queries: one Spark job per operator family, over whole driver tables.

Each entry is ``name -> (spark_fn(spark, sf_dir) -> DataFrame, duckdb_sql | None)``.
Column names are aliased identically on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from archivesearch.functions import hashes as H
from archivesearch.functions import present as PR
from archivesearch.functions import text as T
from archivesearch.functions import timestamps as TS
from archivesearch.functions import urls as U
from archivesearch.operators import extract as X
from archivesearch.operators import fields as FD
from archivesearch.operators import filters as FL
from archivesearch.operators import links as L
from archivesearch.operators import search as S
from archivesearch.operators.docs import join_inlinks, latest_per_key, oldest_version, version_strings
from archivesearch.plans import oracle as O
from archivesearch.plans.corpus import corpus, corpus_docs, corpus_versions
from archivesearch.sources import tables as TB

REGISTRY: dict[str, tuple] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


# ------------------------------------------------------------------ URL scalars

@register("canonical_url", f"SELECT page_id, canon AS canonical_url FROM ({O.lay("SELECT page_id, url FROM pages", O.canonical('url', 'canon', 'c'))})")
def q_canonical_url(spark: SparkSession, d: str) -> DataFrame:
    return U.with_canonical(TB.read_table(spark, d, "pages").select("page_id", "url"), "url", "canonical_url").drop("url")


@register("surt_key", f"SELECT page_id, s AS surt FROM ({O.lay("SELECT page_id, url FROM pages", O.surt('url', 's', 'k'))})")
def q_surt_key(spark, d):
    return U.with_surt(TB.read_table(spark, d, "pages").select("page_id", "url"), "url", "surt").drop("url")


@register("surt_to_url", f"""SELECT page_id, s AS surt, u AS url_back FROM ({O.lay("SELECT page_id, url FROM pages", O.surt('url', 's', 'k'), O.surt_to_url('s', 'u', 'b'))})""")
def q_surt_to_url(spark, d):
    p = TB.read_table(spark, d, "pages").select("page_id", U.surt("url").alias("surt"))
    return p.select("page_id", "surt", U.surt_to_url("surt").alias("url_back"))


@register("strip_www", f"""SELECT page_id, regexp_replace(url, '/$', '') AS stripped_slash, w AS stripped FROM ({O.lay("SELECT page_id, url FROM pages", O.strip_www('url', 'w', 'w'))})""")
def q_strip_www(spark, d):
    return TB.read_table(spark, d, "pages").select(
        "page_id", U.strip_ending_slash("url").alias("stripped_slash"), U.strip_protocol_www("url").alias("stripped"))


@register("url_validator", f"""SELECT doc_id, title,
  regexp_matches(title, {O.q(O.URL_CORE)}) AND NOT regexp_matches(title, '[\\n\\r\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS is_url
FROM (SELECT doc_id, split_part(text, chr(10), 1) AS title FROM documents)
UNION ALL SELECT -1 - page_id AS doc_id, url AS title,
  regexp_matches(url, {O.q(O.URL_CORE)}) AND NOT regexp_matches(url, '[\\n\\r\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS is_url
FROM pages""")
def q_url_validator(spark, d):
    docs = TB.read_table(spark, d, "documents").select(
        "doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"))
    pages = TB.read_table(spark, d, "pages").select((F.lit(-1) - F.col("page_id")).alias("doc_id"), F.col("url").alias("title"))
    both = docs.unionByName(pages)
    return both.select("doc_id", "title", U.is_url("title").alias("is_url"))


# ------------------------------------------------------------------ ids, digests, timestamps

@register("page_id_digest", f"""SELECT page_id, tstamp || '/' || to_base64(unhex(md5(canon))) AS id,
  upper(md5(html)) AS digest, octet_length(encode(html)) AS content_length
FROM ({O.lay("SELECT page_id, html, tstamp, url FROM (" + O.CAPTURED_PAGES + ")", O.canonical('url', 'canon', 'c'))})""")
def q_page_id_digest(spark, d):
    p = TB.captured_pages(spark, d)
    return p.select("page_id", H.page_id("tstamp", U.canonical_url("url")).alias("id"),
                    H.payload_digest("html").alias("digest"),
                    F.octet_length("html").cast("long").alias("content_length"))


_RAW_TS_SPARK = """CASE event_id % 4
  WHEN 0 THEN date_format(ts, 'yyyyMMddHHmmss')
  WHEN 1 THEN date_format(ts, 'yyyyMMdd')
  WHEN 2 THEN props
  ELSE concat(CAST(1985 + event_id % 30 AS STRING), lpad(CAST(event_id % 14 AS STRING), 2, '0'),
              lpad(CAST(event_id % 33 AS STRING), 2, '0'), lpad(CAST(event_id % 25 AS STRING), 2, '0'),
              lpad(CAST(event_id % 61 AS STRING), 2, '0'), lpad(CAST(event_id % 62 AS STRING), 2, '0'),
              CAST(event_id % 10 AS STRING)) END"""
_RAW_TS_DUCK = """CASE event_id % 4
  WHEN 0 THEN strftime(ts, '%Y%m%d%H%M%S')
  WHEN 1 THEN strftime(ts, '%Y%m%d')
  WHEN 2 THEN props
  ELSE CAST(1985 + event_id % 30 AS VARCHAR) || lpad(CAST(event_id % 14 AS VARCHAR), 2, '0')
       || lpad(CAST(event_id % 33 AS VARCHAR), 2, '0') || lpad(CAST(event_id % 25 AS VARCHAR), 2, '0')
       || lpad(CAST(event_id % 61 AS VARCHAR), 2, '0') || lpad(CAST(event_id % 62 AS VARCHAR), 2, '0')
       || CAST(event_id % 10 AS VARCHAR) END"""


@register("canonical_timestamp", f"""SELECT event_id, raw, c AS canonical,
  substr(c, 1, 4) || '-' || substr(c, 5, 2) || '-' || substr(c, 7, 2) || 'T' || substr(c, 9, 2) || ':'
  || substr(c, 11, 2) || ':' || substr(c, 13, 2) || 'Z' AS solr_date
FROM ({O.lay("SELECT event_id, " + _RAW_TS_DUCK + " AS raw FROM events", O.canonical_ts('raw', 'c', 't'))})""")
def q_canonical_timestamp(spark, d):
    e = TB.read_table(spark, d, "events").select("event_id", F.expr(_RAW_TS_SPARK).alias("raw"))
    return e.select("event_id", "raw", TS.canonical_timestamp("raw").alias("canonical"),
                    TS.solr_date("raw").alias("solr_date"))


@register("time_slice", f"""SELECT event_id, tstamp, substr(tstamp, 1, 0) AS slice_none, substr(tstamp, 1, 4) AS slice_year,
  substr(tstamp, 1, 6) AS slice_monthly, substr(tstamp, 1, 8) AS slice_daily
FROM (SELECT event_id, {O.ts14('ts')} AS tstamp FROM events)""")
def q_time_slice(spark, d):
    e = TB.read_table(spark, d, "events").select("event_id", TS.ts14("ts").alias("tstamp"))
    return e.select("event_id", "tstamp", *[TS.time_slice("tstamp", p).alias(f"slice_{p}")
                                            for p in ("none", "year", "monthly", "daily")])


@register("bound_padding", f"""SELECT event_id, raw, rpad(substr(raw, 1, 14), 14, '0') AS bound
FROM (SELECT event_id, {_RAW_TS_DUCK} AS raw FROM events)""")
def q_bound_padding(spark, d):
    e = TB.read_table(spark, d, "events").select("event_id", F.expr(_RAW_TS_SPARK).alias("raw"))
    return e.select("event_id", "raw", TS.bound_padding("raw").alias("bound"))


# ------------------------------------------------------------------ record filters

_DISPOSITION_SQL = """CASE WHEN record_type IS NOT NULL AND record_type NOT IN ('response', 'revisit') THEN 'discarded'
  WHEN url IS NULL THEN 'discarded'
  WHEN NOT starts_with(lower(url), 'http') THEN 'error'
  WHEN status IS NULL THEN 'error'
  WHEN NOT starts_with(status, '2') THEN 'discarded'
  WHEN content_type IS NULL OR NOT regexp_matches(content_type, '/.*[^/]') THEN 'error'
  WHEN lower(split_part(content_type, '/', 1)) IN ('text', 'application')
   AND lower(split_part(split_part(content_type, '/', 2), ';', 1)) NOT IN ('xml', 'css', 'javascript', 'x-javascript', 'json')
   THEN 'accepted' ELSE 'discarded' END"""


@register("record_disposition", f"SELECT record_id, {_DISPOSITION_SQL} AS disposition FROM ({O.RECORDS})")
def q_record_disposition(spark, d):
    r = TB.archive_records(spark, d)
    return r.select("record_id", X.disposition(r).alias("disposition"))


@register("disposition_counts", f"SELECT disposition, count(*) AS records FROM (SELECT {_DISPOSITION_SQL} AS disposition FROM ({O.RECORDS})) GROUP BY disposition")
def q_disposition_counts(spark, d):
    return X.disposition_counts(TB.archive_records(spark, d))


@register("mime_filter", f"""SELECT record_id, content_type FROM ({O.RECORDS})
WHERE content_type IS NOT NULL AND lower(split_part(content_type, '/', 1)) IN ('text', 'application')
  AND lower(split_part(split_part(content_type, '/', 2), ';', 1)) NOT IN ('xml', 'css', 'javascript', 'x-javascript', 'json')""")
def q_mime_filter(spark, d):
    r = TB.archive_records(spark, d)
    return r.filter(F.col("content_type").isNotNull() & X.mime_ok("content_type")).select("record_id", "content_type")


@register("status_filter", f"""SELECT record_id, status FROM ({O.RECORDS})
WHERE (record_type IS NULL OR record_type IN ('response', 'revisit')) AND starts_with(status, '2')""")
def q_status_filter(spark, d):
    r = TB.archive_records(spark, d)
    return r.filter(X.record_type_ok("record_type") & X.status_ok("status")).select("record_id", "status")


# ------------------------------------------------------------------ link graph

@register("invert_links", f"""SELECT DISTINCT s AS surt, substr(tstamp, 1, 4) AS time_slice, from_url, anchor FROM (
  {O.lay("SELECT from_url, anchor, tstamp, to_url FROM (" + O.EDGES + ")", O.surt('to_url', 's', 'k'))})""")
def q_invert_links(spark, d):
    return L.invert_links(TB.link_edges(spark, d), "year")


_ANCHOR_SQL = f"""SELECT surt, time_slice, string_agg(anchor, ' ' ORDER BY anchor, host) || ' ' AS anchor, count(*) AS anchor_count
FROM (SELECT DISTINCT surt, time_slice, host, anchor FROM (
  SELECT s AS surt, '' AS time_slice, lower(nullif(regexp_extract(from_url, '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^@/?#]*@)?([^:/?#]*)', 1), '')) AS host, anchor
  FROM ({O.lay("SELECT from_url, anchor, to_url FROM (" + O.EDGES + ")", O.surt('to_url', 's', 'k'))}))
  WHERE anchor <> '')
GROUP BY surt, time_slice"""


@register("anchor_text", _ANCHOR_SQL)
def q_anchor_text(spark, d):
    return L.anchor_text(L.invert_links(TB.link_edges(spark, d), "none"))


@register("inlink_counts", f"""SELECT surt, time_slice, CAST(count(*) AS INTEGER) AS inlinks FROM (
  SELECT DISTINCT s AS surt, substr(tstamp, 1, 4) AS time_slice, from_url, anchor FROM (
    {O.lay("SELECT from_url, anchor, tstamp, to_url FROM (" + O.EDGES + ")", O.surt('to_url', 's', 'k'))}))
GROUP BY surt, time_slice""")
def q_inlink_counts(spark, d):
    return L.inlink_counts(L.invert_links(TB.link_edges(spark, d), "year"))


_HOST_SQL = "lower(nullif(regexp_extract(from_url, '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^@/?#]*@)?([^:/?#]*)', 1), ''))"


_PAGES_WITH_INLINKS = f"""WITH inl AS (
  SELECT DISTINCT s AS surt, from_url, anchor FROM ({O.lay("SELECT from_url, anchor, to_url FROM (" + O.EDGES + ")", O.surt('to_url', 's', 'k'))})),
cnt AS (SELECT surt, count(*) AS inlinks FROM inl GROUP BY surt),
anc AS (SELECT surt, string_agg(anchor, ' ' ORDER BY anchor, host) || ' ' AS anchor FROM (
  SELECT DISTINCT surt, {_HOST_SQL} AS host, anchor FROM inl WHERE anchor <> '') GROUP BY surt),
pp AS (SELECT p_partkey AS page_key, p_name AS title, s AS surt FROM (
  {O.lay("SELECT p_partkey, p_name, 'http://example.com/p/' || CAST(p_partkey AS VARCHAR) AS url FROM part", O.surt('url', 's', 'p'))}))
SELECT pp.page_key, pp.surt, pp.title, coalesce(anc.anchor, '') AS anchor, CAST(coalesce(cnt.inlinks, 0) AS INTEGER) AS inlinks
FROM pp LEFT JOIN cnt ON cnt.surt = pp.surt LEFT JOIN anc ON anc.surt = pp.surt"""


@register("pages_with_inlinks", _PAGES_WITH_INLINKS)
def q_pages_with_inlinks(spark, d):
    pages = TB.part_pages(spark, d).withColumnRenamed("surt", "surt_url")
    j = join_inlinks(pages, L.invert_links(TB.link_edges(spark, d), "none"), "none")
    return j.select("page_key", "surt", "title", "anchor", "inlinks")


@register("bucketed_links", _PAGES_WITH_INLINKS)
def q_bucketed_links(spark, d):
    """The same from co-partitioned tables, to which two crawls that share pages were appended."""
    from archivesearch.operators.linkstore import LinkStore
    from archivesearch.session import shared_path
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    store = LinkStore.create(spark, shared_path(spark, "linkstore"), "none", buckets, hot_edges=100_000)
    store.add_pages(TB.part_pages(spark, d).withColumnRenamed("surt", "surt_url"))
    edges = TB.link_edges(spark, d).withColumn("o", F.regexp_extract("from_url", "([0-9]+)$", 1).cast("long"))
    for crawl in ("o % 4 < 3", "o % 4 > 0"):
        store.add_edges(edges.filter(crawl).drop("o"))
    return store.pages_with_inlinks().select("page_key", "surt", "title", "anchor", "inlinks")


@register("latest_page_per_key", f"""SELECT surt, time_slice, arg_max(tstamp, tstamp || '|' || warc_name || '|' || lpad(CAST(warc_offset AS VARCHAR), 20, '0')) AS tstamp,
  arg_max(warc_name, tstamp || '|' || warc_name || '|' || lpad(CAST(warc_offset AS VARCHAR), 20, '0')) AS warc_name,
  arg_max(warc_offset, tstamp || '|' || warc_name || '|' || lpad(CAST(warc_offset AS VARCHAR), 20, '0')) AS warc_offset,
  count(*) AS captures
FROM (SELECT s AS surt, substr(tstamp, 1, 4) AS time_slice, tstamp, warc_name, warc_offset FROM (
  {O.lay("SELECT tstamp, warc_name, warc_offset, from_url FROM (" + O.EDGES + ")", O.surt('from_url', 's', 'k'))}))
GROUP BY surt, time_slice""")
def q_latest_page_per_key(spark, d):
    e = TB.link_edges(spark, d).select(F.col("from_url").alias("url"), "tstamp", "warc_name", "warc_offset")
    pages = U.with_surt(e, "url", "surt_url").drop("url")
    latest = latest_per_key(pages, "year", captures="captures").filter("surt is not null and time_slice is not null")
    return latest.select("surt", "time_slice", "tstamp", "warc_name", "warc_offset", "captures")


@register("merge_edges", f"""SELECT DISTINCT s AS surt, substr(tstamp, 1, 4) AS time_slice, from_url, anchor FROM (
  {O.lay("SELECT from_url, anchor, tstamp, to_url FROM (" + O.EDGES + ")", O.surt('to_url', 's', 'k'))})""")
def q_merge_edges(spark, d):
    """Two crawls that share the pages of every second order."""
    edges = TB.link_edges(spark, d).withColumn("o", F.regexp_extract("from_url", "([0-9]+)$", 1).cast("long"))
    a = L.invert_links(edges.filter("o % 4 < 3").drop("o"), "year")
    b = L.invert_links(edges.filter("o % 4 > 0").drop("o"), "year")
    return L.merge_edges(a, b)


# ------------------------------------------------------------------ version documents

_VDOC_CTES = O.CORPUS[:2]


@register("version_docs", O.with_ctes(*_VDOC_CTES, body="""SELECT id, titleString, type, surtOldest, collection, urlOldest,
  tstampOldest, tstampLatest, captures, versions FROM vdocs"""))
def q_version_docs(spark, d):
    docs = corpus_docs(spark, d).join(version_strings(corpus_versions(spark, d)), F.col("id") == F.col("doc_id"))
    return docs.select("id", "titleString", "type", "surtOldest", "collection", "urlOldest", "tstampOldest",
                       "tstampLatest", "captures", "versions")


@register("oldest_version", O.with_ctes(_VDOC_CTES[0], ("old", O.oldest_of()), body=f"""
SELECT id, o_tstamp AS tstamp, o_collection AS collection, o_surt AS surt, u AS originalURL FROM (
  {O.lay("SELECT id, o_tstamp, o_collection, o_surt FROM old", O.surt_to_url('o_surt', 'u', 'b'))})"""))
def q_oldest_version(spark, d):
    docs = oldest_version(corpus_versions(spark, d), ["doc_id"])
    return docs.select(F.col("doc_id").alias("id"), F.col("oldest.tstamp").alias("tstamp"),
                       F.col("oldest.collection").alias("collection"), F.col("oldest.surt").alias("surt"),
                       U.surt_to_url(F.col("oldest.surt")).alias("originalURL"))


@register("version_filter", O.with_ctes(_VDOC_CTES[0], body="""
SELECT digest AS id, count(*) AS n_kept,
  string_agg(collection || '/' || tstamp || '/' || surt, ' ' ORDER BY collection || '/' || tstamp || '/' || surt) AS kept
FROM (SELECT DISTINCT digest, collection, tstamp, surt FROM doc_captures)
WHERE CAST(tstamp AS BIGINT) >= 20150101000000 AND CAST(tstamp AS BIGINT) <= 20150601000000
  AND collection IN ('col0', 'col2') AND starts_with(surt, '(org,example,')
GROUP BY digest"""))
def q_version_filter(spark, d):
    kept = corpus_versions(spark, d).filter(FL.version_keeps(
        "tstamp", "surt", "collection", FL.canonical_bound(F.lit("2015")), FL.canonical_bound(F.lit("201506")),
        F.array(U.surt(F.lit("http://example.org"))), F.array(F.lit("col0"), F.lit("col2"))))
    counts = kept.groupBy("doc_id").agg(F.count("*").alias("n_kept"))
    return counts.join(version_strings(kept), "doc_id").select(
        F.col("doc_id").alias("id"), "n_kept", F.col("versions").alias("kept"))


# ------------------------------------------------------------------ per-query filters

def _request(spark, d, **params) -> DataFrame:
    b = TB.read_table(spark, d, "benchmark").select(F.col("item_id").alias("qid"))
    return b.select("qid", *[v.alias(k) for k, v in params.items()])


def _filtered(spark, d, requests: DataFrame) -> DataFrame:
    """Filter-only requests through the page search: the page and the number of all results."""
    c = corpus(spark, d, keys=bool(FD.used(requests)))
    off = requests.withColumns({"dedup_value": F.lit(-1), "fields": F.array(F.lit("id"))})
    res, summ = S.page_search(off, c.docs, c.versions, c.index, keys=c.keys)
    return res.join(summ.select("qid", "estimated_results"), "qid").select(
        "qid", F.col("rank").cast("int").alias("rank"), "doc_id", "estimated_results")


def _page_of(eligible: str, keeps: str = "true") -> str:
    """Oracle of a filter-only page: 50 documents by id, less those without a kept version."""
    return O.with_ctes(_VDOC_CTES[0], ("vdocs", O.VERSION_DOCS),
                       ("caps", "SELECT DISTINCT digest, surt, collection, tstamp FROM doc_captures"),
                       ("req", "SELECT item_id AS qid FROM benchmark"), ("eligible", eligible), body=f"""
SELECT qid, CAST(rank AS INTEGER) AS rank, doc_id, estimated_results FROM (
  SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY doc_id) AS rank,
         count(*) OVER (PARTITION BY qid) AS estimated_results FROM eligible) e
WHERE rank <= 50 AND EXISTS (SELECT 1 FROM caps c WHERE c.digest = e.doc_id AND {keeps})""")


@register("site_filter", _page_of("""SELECT DISTINCT r.qid, c.digest AS doc_id FROM req r JOIN caps c
  ON starts_with(c.surt, '(org,example,src' || CAST(r.qid % 20 AS VARCHAR) || ',')"""))
def q_site_filter(spark, d):
    site = F.array(F.concat(F.lit("http://www.src"), (F.col("qid") % 20).cast("string"), F.lit(".example.org/")))
    return _filtered(spark, d, _request(spark, d, site=site))


_TYPE_CHOICES = ["pdf", "html", "text/plain", "word"]


@register("type_filter", _page_of("""SELECT r.qid, v.id AS doc_id FROM req r JOIN vdocs v ON
  CASE r.qid % 4 WHEN 0 THEN v.type = 'application/pdf' WHEN 1 THEN v.type = 'text/html'
                 WHEN 2 THEN v.type = 'text/plain' ELSE contains(v.type, 'word') END"""))
def q_type_filter(spark, d):
    t = F.array(F.element_at(F.array(*[F.lit(x) for x in _TYPE_CHOICES]), (F.col("qid") % 4 + 1).cast("int")))
    return _filtered(spark, d, _request(spark, d, type=t))


@register("collection_filter", _page_of("""SELECT DISTINCT r.qid, c.digest AS doc_id FROM req r JOIN caps c
  ON c.collection = 'col' || CAST(r.qid % 3 AS VARCHAR)"""))
def q_collection_filter(spark, d):
    return _filtered(spark, d, _request(
        spark, d, collection=F.array(F.concat(F.lit("col"), (F.col("qid") % 3).cast("string")))))


_FROM = "CAST(2015 + e.qid % 2 AS VARCHAR) || lpad(CAST(e.qid % 12 + 1 AS VARCHAR), 2, '0') || '01000000'"


@register("time_overlap", _page_of("""SELECT r.qid, v.id AS doc_id FROM req r JOIN vdocs v ON
  v.tstampLatest >= CAST(2015 + r.qid % 2 AS VARCHAR) || lpad(CAST(r.qid % 12 + 1 AS VARCHAR), 2, '0') || '01000000'
  AND v.tstampOldest <= CAST(2015 + r.qid % 2 AS VARCHAR) || '1201000000'""",
    f"c.tstamp >= {_FROM} AND c.tstamp <= CAST(2015 + e.qid % 2 AS VARCHAR) || '1201000000'"))
def q_time_overlap(spark, d):
    year = (F.lit(2015) + F.col("qid") % 2).cast("string")
    frm = F.concat(year, F.lpad((F.col("qid") % 12 + 1).cast("string"), 2, "0"))
    return _filtered(spark, d, _request(spark, d, **{"from": frm, "to": F.concat(year, F.lit("12"))}))


@register("fielded_search", _page_of("""SELECT DISTINCT t.doc_id AS qid, c.digest AS doc_id
FROM (SELECT d.* FROM doc_captures d JOIN req ON req.qid = d.doc_id) t JOIN doc_captures c ON CASE t.doc_id % 7
  WHEN 0 THEN c.url = t.url WHEN 1 THEN c.url = t.url WHEN 2 THEN c.collection = t.collection AND c.site = t.site WHEN 3 THEN c.site = t.site
  WHEN 4 THEN substr(c.tstamp, 1, 6) = substr(t.tstamp, 1, 6) WHEN 5 THEN substr(c.tstamp, 1, 4) = substr(t.tstamp, 1, 4) AND c.collection = t.collection
  ELSE c.lang = t.lang AND c.site = t.site AND c.collection = t.collection END"""))
def q_fielded_search(spark, d):
    """A batch that mixes all field filters, alone and together, with values taken from captures."""
    items = TB.read_table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"))
    t = TB.document_captures(spark, d).join(items, "doc_id")
    arc = F.concat(F.lit("DOC-"), "collection", F.lit(".warc.gz"))
    domain = F.concat("site", F.lit(".example.org"))

    def value(column, *kinds):
        return F.when((F.col("doc_id") % 7).isin(*kinds), F.array(column))

    return _filtered(spark, d, t.select(
        F.col("doc_id").alias("qid"), value(F.col("url"), 0).alias("exacturl"),
        value(F.regexp_replace("url", "^http:", "https:"), 1).alias("exacturlexpand"), value(arc, 2, 5, 6).alias("arcname"),
        value(domain, 2, 3, 6).alias("domain"), F.when(F.col("doc_id") % 7 == 4, F.array(F.substring("tstamp", 1, 6))).when(
            F.col("doc_id") % 7 == 5, F.array(F.substring("tstamp", 1, 4))).alias("date"), value(F.upper("lang"), 6).alias("lang")))


@register("title_filter", _page_of("""SELECT c.doc_id AS qid, v.id AS doc_id FROM doc_captures c JOIN vdocs v ON v.titleString = c.title"""))
def q_title_filter(spark, d):
    return _filtered(spark, d, TB.document_captures(spark, d).select(
        F.col("doc_id").alias("qid"), F.col("title").alias("title_search")))


@register("match_all", O.with_ctes(_VDOC_CTES[0], ("vdocs", O.VERSION_DOCS), body="""
, req AS (SELECT item_id AS qid, (['title', 'type', 'collection', 'site'])[item_id % 4 + 1] AS f,
         item_id % 3 AS off, item_id % 4 AS n FROM benchmark),
keyed AS (SELECT r.*, v.id AS doc_id, CASE r.f WHEN 'type' THEN v.type WHEN 'collection' THEN v.collection
            WHEN 'site' THEN v.surtOldest ELSE v.titleString END AS k FROM req r CROSS JOIN vdocs v),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid, k ORDER BY doc_id) AS group_rank FROM keyed WHERE k IS NOT NULL),
heads AS (SELECT qid, k, row_number() OVER (PARTITION BY qid ORDER BY doc_id) AS rank,
                 count(*) OVER (PARTITION BY qid) AS estimated_results FROM ranked WHERE group_rank = 1)
SELECT r.qid, CAST(h.rank AS INTEGER) AS rank, CAST(r.group_rank AS INTEGER) AS group_rank, r.doc_id, h.estimated_results
FROM ranked r JOIN heads h ON h.qid = r.qid AND h.k = r.k
WHERE h.rank > r.off AND h.rank <= r.off + 3 AND r.group_rank <= greatest(r.n, 1)""").replace("\n, req AS", ",\nreq AS"))
def q_match_all(spark, d):
    c = corpus(spark, d, keys=False)
    names = F.array(*[F.lit(x) for x in ("title", "type", "collection", "site")])
    req = _request(spark, d, dedup_field=F.element_at(names, (F.col("qid") % 4 + 1).cast("int")),
                   offset=(F.col("qid") % 3).cast("int"), dedup_value=(F.col("qid") % 4).cast("int"), max_items=F.lit(3))
    res, summ = S.page_search(req, c.docs, c.versions, c.index)
    return res.join(summ.select("qid", "estimated_results"), "qid").select(
        "qid", F.col("rank").cast("int").alias("rank"), F.col("group_rank").cast("int").alias("group_rank"),
        "doc_id", "estimated_results")


# ------------------------------------------------------------------ matching and ranking

_SEARCH_CTES = O.CORPUS + [("workload", O.WORKLOAD), ("qterms", O.QTERMS)]


ANY = S.SearchConfig(operator="or", with_snippet=False)


def _workload(spark, d, **params) -> DataFrame:
    """Requests from ``benchmark``: its whole texts, one query each."""
    b = TB.read_table(spark, d, "benchmark")
    cols = {"q": F.array_join(T.tokens("text"), " "), **params}
    return b.select(F.col("item_id").alias("qid"), *[v.alias(k) for k, v in cols.items()])


PAIRS = 1_000_000_000  # more than a text has tokens: a qid is an item and a place in it


def _pairs(spark, d, distinct: bool, query) -> DataFrame:
    """One request per adjacent pair of tokens (all, or distinct ones) of each ``benchmark`` text."""
    toks = F.array_distinct(T.tokens("text")) if distinct else T.tokens("text")
    b = TB.read_table(spark, d, "benchmark").select("item_id", toks.alias("t")).filter("size(t) > 1")
    rest = F.size("t") - 1
    p = b.select("item_id", F.posexplode(F.arrays_zip(F.slice("t", F.lit(1), rest).alias("a"), F.slice("t", F.lit(2), rest).alias("b"))))
    return p.select((F.col("item_id") * PAIRS + F.col("pos") + 1).alias("qid"),
                    query(F.col("col")["a"], F.col("col")["b"]).alias("q"))


def _pairs_sql(toks: str) -> tuple[str, str]:
    return ("w2", f"""SELECT item_id * {PAIRS} + i AS qid, t[i] AS t1, t[i + 1] AS t2
FROM (SELECT item_id, t, unnest(range(1, len(t))) AS i FROM ({toks}))""")


_ALL_PAIRS = _pairs_sql(f"SELECT item_id, {O.tokens('text')} AS t FROM benchmark")
_DISTINCT_PAIRS = _pairs_sql(f"""SELECT item_id, list_filter(a, lambda x, i: list_position(a, x) = i) AS t FROM (
  SELECT item_id, {O.tokens('text')} AS a FROM benchmark)""")


def _analyzed(queries: DataFrame) -> DataFrame:
    return S.analyze_queries(S.normalize_queries(queries))


@register("term_match", O.with_ctes(*_SEARCH_CTES, body="""
SELECT DISTINCT t.qid, p.doc_id FROM qterms t JOIN postings p ON p.term = t.term"""))
def q_term_match(spark, d):
    return S.match_terms(_analyzed(_workload(spark, d)), corpus(spark, d, keys=False).index, ANY).select("qid", "doc_id")


@register("all_terms_match", O.with_ctes(*O.CORPUS, _DISTINCT_PAIRS, body="""
SELECT DISTINCT w.qid, p.doc_id FROM w2 w JOIN postings p ON p.term = w.t1
JOIN postings x ON x.term = w.t2 AND x.doc_id = p.doc_id"""))
def q_all_terms_match(spark, d):
    aq = _analyzed(_pairs(spark, d, True, lambda a, b: F.concat(a, F.lit(" "), b)))
    return S.match_terms(aq, corpus(spark, d, keys=False).index).select("qid", "doc_id")


@register("bm25_topk", O.with_ctes(*_SEARCH_CTES, ("scored", O.bm25_scores("qterms")), body="""
SELECT qid, doc_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= 10"""))
def q_bm25_topk(spark, d):
    m = S.match_terms(_analyzed(_workload(spark, d)), corpus(spark, d, keys=False).index, ANY)
    w = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("doc_id"))
    return m.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= 10).select(
        "qid", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


_TP = ("tp", "SELECT doc_id, field, unnest(toks) AS term, generate_subscripts(toks, 1) AS pos FROM field_tokens")


_PHRASE_SQL = O.with_ctes(*O.CORPUS, _TP, _ALL_PAIRS, body="""
SELECT DISTINCT w.qid, a.doc_id FROM w2 w JOIN tp a ON a.term = w.t1
JOIN tp b ON b.doc_id = a.doc_id AND b.field = a.field AND b.pos = a.pos + 1 AND b.term = w.t2""")


@register("phrase_common", _PHRASE_SQL)
def q_phrase_common(spark, d):
    """The same phrases from an index with postings of pairs of common terms."""
    from archivesearch.operators.index import add_pairs
    from archivesearch.session import shared_path
    c = corpus(spark, d, keys=False)
    index = add_pairs(c.docs, c.index, shared_path(spark, "pair-index"), common_share=0.02)
    quoted = _pairs(spark, d, False, lambda a, b: F.concat(F.lit('"'), a, F.lit(" "), b, F.lit('"')))
    return S.match_phrases(_analyzed(quoted), index)


@register("phrase_match", O.with_ctes(*O.CORPUS, _TP, _ALL_PAIRS, body="""
SELECT DISTINCT w.qid, a.doc_id FROM w2 w JOIN tp a ON a.term = w.t1
JOIN tp b ON b.doc_id = a.doc_id AND b.field = a.field AND b.pos = a.pos + 1 AND b.term = w.t2"""))
def q_phrase_match(spark, d):
    c = corpus(spark, d, keys=False)
    aq = _analyzed(_pairs(spark, d, False, lambda a, b: F.concat(F.lit('"'), a, F.lit(" "), b, F.lit('"'))))
    return S.candidates(aq, c.docs, c.versions, c.index).select("qid", "doc_id")


@register("exclude_terms", O.with_ctes(*O.CORPUS, _DISTINCT_PAIRS, body="""
SELECT DISTINCT w.qid, p.doc_id FROM w2 w JOIN postings p ON p.term = w.t1
WHERE NOT EXISTS (SELECT 1 FROM postings x WHERE x.doc_id = p.doc_id AND x.term = w.t2)"""))
def q_exclude_terms(spark, d):
    aq = _analyzed(_pairs(spark, d, True, lambda a, b: F.concat(a, F.lit(" -"), b)))
    return S.match_terms(aq, corpus(spark, d, keys=False).index).select("qid", "doc_id")


@register("field_match", O.with_ctes(*_SEARCH_CTES, body="""
SELECT DISTINCT t.qid, p.doc_id FROM qterms t JOIN postings p ON p.term = t.term AND p.field = 'title'"""))
def q_field_match(spark, d):
    cfg = S.SearchConfig(operator="or", match_fields=("title",))
    return S.match_terms(_analyzed(_workload(spark, d)), corpus(spark, d, keys=False).index, cfg).select("qid", "doc_id")


_CODE = "ascii(anchor) * 256 + ascii(substr(anchor, 2, 1))"


@register("anchor_match", f"""WITH anc AS (
  SELECT DISTINCT s AS surt, anchor FROM ({O.lay("SELECT anchor, to_url FROM (" + O.EDGES + ")", O.surt('to_url', 's', 'k'))}) WHERE anchor <> ''),
pp AS (SELECT p_partkey, s AS surt FROM (
  {O.lay("SELECT p_partkey, 'http://example.com/p/' || CAST(p_partkey AS VARCHAR) AS url FROM part", O.surt('url', 's', 'p'))}))
SELECT CAST({_CODE} AS BIGINT) AS qid, CAST(p_partkey AS VARCHAR) AS doc_id FROM pp JOIN anc ON anc.surt = pp.surt""")
def q_anchor_match(spark, d):
    """Pages found by the text of the links to them, an indexed field of its own."""
    from archivesearch.operators.index import build_index
    from archivesearch.session import shared_path, stored
    edges = TB.link_edges(spark, d)
    pages = join_inlinks(TB.part_pages(spark, d).withColumnRenamed("surt", "surt_url"), L.invert_links(edges, "none"), "none")
    docs = pages.select(F.col("page_key").cast("string").alias("id"), F.col("title").alias("titleString"), "anchor")
    index = build_index(stored(docs, "anchor-docs"), shared_path(spark, "anchor-index"), {"title": "titleString", "anchor": "anchor"})
    words = edges.filter("anchor <> ''").select("anchor").distinct()
    requests = words.select(F.expr(_CODE).cast("long").alias("qid"), F.col("anchor").alias("q"))
    return S.match_terms(_analyzed(requests), index, S.SearchConfig(match_fields=("anchor",))).select("qid", "doc_id")


# ------------------------------------------------------------------ full batch search

_RESULT_COLS = ["qid", "rank", "group_rank", "doc_id", "score", "title", "originalURL", "tstamp",
                "collection", "mimeType"]


def _search_sql(key: str, keep: str, off: str, offset: str, max_items: str) -> str:
    return O.with_ctes(*_SEARCH_CTES, body=f""", {O.ranked_search('', key, keep, off, offset, max_items)},
old AS ({O.oldest_of()}),
out AS (SELECT r.qid, r.rank, r.group_rank, r.doc_id, r.score, coalesce(d.titleString, '') AS title,
          o.o_surt, CAST(o.o_tstamp AS BIGINT) AS tstamp, o.o_collection AS collection, coalesce(d.type, '') AS mimeType
        FROM res r JOIN vdocs d ON d.id = r.doc_id JOIN old o ON o.id = r.doc_id)
SELECT qid, CAST(rank AS INTEGER) AS rank, CAST(group_rank AS INTEGER) AS group_rank, doc_id, score, title, u AS originalURL,
  tstamp, collection, mimeType FROM ({O.lay("SELECT * FROM out", O.surt_to_url('o_surt', 'u', 'b'))})""").replace("WITH ", "WITH ", 1).replace("\n, scored", ",\nscored")


def _search(spark, d, cfg: S.SearchConfig = ANY, **params):
    c = corpus(spark, d, keys=False)
    return S.page_search(_workload(spark, d, **params), c.docs, c.versions, c.index, cfg)


def _results(spark, d, cfg: S.SearchConfig = ANY, **params):
    res, _ = _search(spark, d, cfg, **params)
    return res.select(*[F.col(c).cast("int") if c in ("rank", "group_rank") else F.col(c) for c in _RESULT_COLS])


@register("batch_search", _search_sql("d.titleString", "2", "false", "0", "50"))
def q_batch_search(spark, d):
    return _results(spark, d)


@register("collapse_expand", _search_sql("d.type", "3", "false", "0", "10"))
def q_collapse_expand(spark, d):
    return _results(spark, d, dedup_field=F.lit("type"), dedup_value=F.lit(3), max_items=F.lit(10))


@register("per_dup_hits", _search_sql(
    "lower(nullif(regexp_extract(d.urlOldest, '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^@/?#]*@)?([^:/?#]*)', 1), ''))",
    "1", "false", "0", "50"))
def q_per_dup_hits(spark, d):
    return _results(spark, d, S.SearchConfig(operator="or", with_snippet=False, off_value=0), dedup_field=F.lit("title"), dedup_value=F.lit(1))


@register("page_offset", _search_sql("d.collection", "2", "false", "1", "2"))
def q_page_offset(spark, d):
    return _results(spark, d, dedup_field=F.lit("collection"), dedup_value=F.lit(2), offset=F.lit(1),
                    max_items=F.lit(2))


def _summary_sql(key: str, keep: str, off: str, offset: int, max_items: int) -> str:
    base = _search_sql(key, keep, off, str(offset), str(max_items))
    head, _, _ = base.rpartition("\nSELECT qid, CAST(rank")
    return head + f"""
, est AS (SELECT qid, count(*) AS estimated_results FROM kept2 WHERE group_rank = 1 GROUP BY qid)
SELECT w.qid, coalesce(e.estimated_results, 0) AS estimated_results,
  greatest(least(coalesce(e.estimated_results, 0) - {offset}, {max_items}), 0) AS number_results,
  coalesce(e.estimated_results, 0) <= {offset + max_items} AS last_page,
  CASE WHEN coalesce(e.estimated_results, 0) <= {offset + max_items} THEN NULL ELSE {offset + max_items} END AS next_offset,
  {('CAST(NULL AS INTEGER)' if offset == 0 else f'greatest({offset} - {max_items}, 0)')} AS previous_offset
FROM workload w LEFT JOIN est e ON e.qid = w.qid"""


def _summary(spark, d, cfg: S.SearchConfig = ANY, **params):
    _, summ = _search(spark, d, cfg, **params)
    return summ.select("qid", "estimated_results", "number_results", "last_page",
                       F.col("next_offset").cast("int").alias("next_offset"),
                       F.col("previous_offset").cast("int").alias("previous_offset"))


@register("hit_counts", _summary_sql("d.collection", "1", "false", 1, 2))
def q_hit_counts(spark, d):
    return _summary(spark, d, dedup_field=F.lit("collection"), dedup_value=F.lit(1), offset=F.lit(1),
                    max_items=F.lit(2))


@register("last_page", _summary_sql("d.surtOldest", "1", "true", 0, 5))
def q_last_page(spark, d):
    return _summary(spark, d, dedup_value=F.lit(-1), max_items=F.lit(5))


# ------------------------------------------------------------------ presentation

@register("snippet_fallback", O.with_ctes(*O.CORPUS[:2], body=f"""
SELECT id, CASE WHEN length(coalesce(content, '')) <= 500 THEN coalesce(content, '')
  ELSE substr(content, 1, 500) || {O.q(PR.ELLIPSIS)} END AS snippet FROM vdocs"""))
def q_snippet_fallback(spark, d):
    return corpus_docs(spark, d).select("id", PR.snippet_fallback("content").alias("snippet"))


_EP = PR.Endpoints()


@register("result_links", O.with_ctes(O.CORPUS[0], ("old", O.oldest_of()), body=f"""
SELECT id, u AS originalURL, o_tstamp AS tstamp,
  {O.q(_EP.wayback + '/')} || o_tstamp || '/' || u AS linkToArchive,
  {O.q(_EP.noframe + '/')} || o_tstamp || '/' || u AS linkToNoFrame,
  {O.q(_EP.screenshot + '?url=')} || url_encode({O.q(_EP.noframe + '/')} || o_tstamp || '/' || u) AS linkToScreenshot,
  {O.q(_EP.extracted_text + '?m=')} || url_encode(u || '/' || o_tstamp) AS linkToExtractedText,
  {O.q(_EP.textsearch + '?metadata=')} || url_encode(u || '/' || o_tstamp) AS linkToMetadata,
  {O.q(_EP.noframe + '/')} || o_tstamp || 'id_/' || u AS linkToOriginalFile
FROM ({O.lay("SELECT id, o_tstamp, o_surt FROM old", O.surt_to_url('o_surt', 'u', 'b'))})"""))
def q_result_links(spark, d):
    docs = oldest_version(corpus_versions(spark, d), ["doc_id"])
    r = docs.select(F.col("doc_id").alias("id"), U.surt_to_url(F.col("oldest.surt")).alias("originalURL"),
                    F.col("oldest.tstamp").alias("tstamp"))
    return PR.with_links(r, "originalURL", "tstamp", _EP)


@register("snippet")
def q_snippet(spark, d):
    res, _ = _search(spark, d, S.SearchConfig(operator="or"), max_items=F.lit(10))
    return res.select("qid", "rank", "group_rank", "doc_id", "snippet")


def _snippet_sql(max_items: int) -> str:
    """Best windows by brute SQL: every hit begins a window of 40 words; two are chosen, the second wholly outside the first."""
    base = _search_sql("d.titleString", "2", "false", "0", str(max_items))
    head, _, _ = base.rpartition("\nSELECT qid, CAST(rank")
    lead = "(40 - (last - pos + 1)) // 2"
    low = f"greatest(1, least(pos - {lead}, n_words - 39))"

    def pick(name: str, source: str) -> str:
        return f"""{name} AS (SELECT qid, doc_id, n_words, {low} AS lo, least({low} + 39, n_words) AS hi FROM (
  SELECT s.*, t.n_words, row_number() OVER (PARTITION BY s.qid, s.doc_id ORDER BY terms DESC, n DESC, pos) AS r
  FROM {source} s JOIN texts t USING (qid, doc_id)) WHERE r = 1)"""

    return head + f""",
texts AS (SELECT DISTINCT r.qid, r.doc_id, content, words, len(words) AS n_words FROM res r JOIN (
  SELECT id, content, string_split_regex(trim(coalesce(content, '')), '[ \t\n\x0B\f\r]+') AS words FROM vdocs) d ON d.id = r.doc_id),
places AS (SELECT qid, doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM texts),
found AS (SELECT DISTINCT p.qid, p.doc_id, p.pos, p.term FROM (SELECT qid, doc_id, pos, unnest({O.tokens('word')}) AS term FROM places) p
  JOIN qterms t ON t.qid = p.qid AND t.term = p.term),
scanned AS (SELECT DISTINCT a.qid, a.doc_id, a.pos, b.terms, b.n, b.last FROM found a JOIN (
  SELECT x.qid, x.doc_id, x.pos, count(DISTINCT y.term) AS terms, count(*) AS n, max(y.pos) AS last
  FROM (SELECT DISTINCT qid, doc_id, pos FROM found) x JOIN found y ON y.qid = x.qid AND y.doc_id = x.doc_id AND y.pos BETWEEN x.pos AND x.pos + 39
  GROUP BY ALL) b USING (qid, doc_id, pos)),
{pick('one', 'scanned')},
rest AS (SELECT s.* FROM scanned s JOIN one USING (qid, doc_id) WHERE s.pos > one.hi OR s.last < one.lo),
{pick('two', 'rest')},
pieces AS (SELECT qid, doc_id, greatest(lo, coalesce(lag(hi) OVER (PARTITION BY qid, doc_id ORDER BY lo, hi) + 1, lo)) AS lo, hi
           FROM (SELECT * FROM one UNION ALL SELECT * FROM two)),
written AS (SELECT qid, doc_id, string_agg(piece, '' ORDER BY lo) AS snippet FROM (
  SELECT c.qid, c.doc_id, c.lo, string_agg(CASE WHEN f.pos IS NULL THEN p.word ELSE '<em>' || p.word || '</em>' END, ' ' ORDER BY p.pos) || {O.q(PR.ELLIPSIS)} AS piece
  FROM pieces c JOIN places p ON p.qid = c.qid AND p.doc_id = c.doc_id AND p.pos BETWEEN c.lo AND c.hi
  LEFT JOIN (SELECT DISTINCT qid, doc_id, pos FROM found) f ON f.qid = p.qid AND f.doc_id = p.doc_id AND f.pos = p.pos GROUP BY ALL) GROUP BY ALL)
SELECT r.qid, CAST(r.rank AS INTEGER) AS rank, CAST(r.group_rank AS INTEGER) AS group_rank, r.doc_id,
  coalesce(w.snippet, CASE WHEN length(coalesce(t.content, '')) <= 500 THEN coalesce(t.content, '') ELSE substr(t.content, 1, 500) || {O.q(PR.ELLIPSIS)} END) AS snippet
FROM res r JOIN texts t USING (qid, doc_id) LEFT JOIN written w USING (qid, doc_id)"""


@register("snippet_best", _snippet_sql(10))
def q_snippet_best(spark, d):
    """Snippets by the best windows, of titles and contents matched by any term."""
    res, _ = _search(spark, d, S.SearchConfig(operator="or", snippet_strategy="best"), max_items=F.lit(10))
    return res.select("qid", F.col("rank").cast("int").alias("rank"), F.col("group_rank").cast("int").alias("group_rank"), "doc_id", "snippet")


_ANALYSIS_SQL = f"""SELECT qid, '"' || t1 || ' ' || t2 || '" ' || t1 || ' -' || t2 || ' "unclosed' AS q,
  array_to_string(list_distinct_ordered, ' ') AS terms, t1 || ' ' || t2 AS phrases, t2 AS excludes, 'ok' AS status
FROM (SELECT *, CASE WHEN t1 = 'unclosed' THEN [t1] ELSE [t1, 'unclosed'] END AS list_distinct_ordered FROM w2)"""


@register("query_analysis", O.with_ctes(_ALL_PAIRS, body=_ANALYSIS_SQL))
def q_query_analysis(spark, d):
    """Phrase, plain term, exclusion and an unclosed quote, from each adjacent pair of tokens."""
    q = _pairs(spark, d, False, lambda a, b: F.concat(F.lit('"'), a, F.lit(" "), b, F.lit('" '), a, F.lit(" -"), b,
                                                      F.lit(' "unclosed')))
    return _analyzed(q).select("qid", "q", F.array_join("terms", " ").alias("terms"),
                     F.array_join(F.transform("phrases", lambda p: F.array_join(p, " ")), "|").alias("phrases"),
                     F.array_join("excludes", " ").alias("excludes"), "status")


# ------------------------------------------------------------------ extraction (E1-E5) and exports

_PAGE_LINKS = r"""SELECT *, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS raw_title,
  regexp_extract_all(html, '(?:href|src)="([^"]+)"', 1) AS hrefs FROM (""" + O.CAPTURED_PAGES + ")"


@register("page_title_links", f"""SELECT tstamp || '/' || to_base64(unhex(md5(c_canon))) AS id, c_canon AS url, k_s AS surt_url,
  replace(replace(replace(replace(raw_title, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS title, CAST(len(hrefs) AS INTEGER) AS outlinks,
  octet_length(encode(html)) AS content_length, upper(md5(html)) AS digest, 'text/html' AS type, CAST(len(hrefs) AS INTEGER) AS n_links
FROM ({O.lay(_PAGE_LINKS, O.canonical('url', 'c_canon', 'c'), O.surt('url', 'k_s', 'k'))})""")
def q_page_title_links(spark, d):
    pages = X.build_page_data(TB.captured_pages(spark, d))
    return pages.select("id", "url", "surt_url", "title", "outlinks", "content_length", "digest", "type",
                        F.size("out_links").alias("n_links"))


@register("search_doc_json")
def q_search_doc_json(spark, d):
    from archivesearch.plans.indexing import index_pages
    docs = index_pages(TB.captured_pages(spark, d), policy="none")
    return PR.to_json_lines(docs)


@register("search_log")
def q_search_log(spark, d):
    from archivesearch.operators.log import search_log
    res, _ = _search(spark, d, max_items=F.lit(10))
    return search_log(_workload(spark, d), res)


# ------------------------------------------------------------------ captures

from archivesearch.operators import captures as C  # noqa: E402
from archivesearch.operators import metadata as M  # noqa: E402


@register("complete_captures", f"""SELECT "offset", url IS NOT NULL AND url <> '' AND timestamp IS NOT NULL AND timestamp <> ''
  AND digest IS NOT NULL AND digest <> '' AND mime IS NOT NULL AND mime <> '' AND status IS NOT NULL AND status <> ''
  AND filename IS NOT NULL AND filename <> '' AND length IS NOT NULL AND length <> ''
  AND "offset" IS NOT NULL AND "offset" <> '' AS complete FROM ({O.CDX})""")
def q_complete_captures(spark, d):
    c = TB.cdx_captures(spark, d)
    return c.select("offset", C.is_complete(c).alias("complete"))


@register("distinct_captures", f"""WITH c AS ({O.CDX})
SELECT digest, timestamp, count(*) AS copies FROM (SELECT * FROM c UNION ALL SELECT * FROM c WHERE mime = 'text/html')
GROUP BY digest, timestamp""")
def q_distinct_captures(spark, d):
    """Two capture servers, of which one knows the HTML captures only."""
    c = TB.cdx_captures(spark, d)
    return C.distinct_captures(c.unionByName(c.filter("mime = 'text/html'")))


@register("version_history", f"""WITH cdx AS ({O.CDX}),
m AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY timestamp DESC, digest, "offset") AS pos,
             count(*) OVER (PARTITION BY url) AS total
      FROM cdx WHERE timestamp >= '20240105000000' AND timestamp <= '20240125999999')
SELECT CAST(regexp_extract(url, '/u/([0-9]+)$', 1) AS BIGINT) AS req_id, CAST(pos AS INTEGER) AS pos, timestamp, digest,
  url AS title, mime, filename, total
FROM m WHERE pos > 1 AND pos <= 6""")
def q_version_history(spark, d):
    users = TB.read_table(spark, d, "events").select("user_id").distinct()
    req = users.select(F.col("user_id").alias("req_id"),
                       F.concat(F.lit("http://www.site"), (F.col("user_id") % 7).cast("string"),
                                F.lit(".example.pt/u/"), F.col("user_id").cast("string")).alias("url"),
                       F.lit("20240105").alias("from"), F.lit("20240125").alias("to"),
                       F.lit(1).alias("start"), F.lit(5).alias("limit"))
    rows, totals = C.version_history(req, TB.cdx_captures(spark, d))
    return rows.join(totals, "req_id").select("req_id", F.col("pos").cast("int").alias("pos"), "timestamp", "digest",
                                              F.col("url").alias("title"), "mime", "filename", "total")


@register("closest_capture", f"""WITH cdx AS ({O.CDX})
SELECT CAST(regexp_extract(url, '/u/([0-9]+)$', 1) AS BIGINT) AS req_id,
  arg_min(timestamp, lpad(CAST(diff AS VARCHAR), 12, '0') || timestamp || digest) AS timestamp,
  arg_min(digest, lpad(CAST(diff AS VARCHAR), 12, '0') || timestamp || digest) AS digest,
  arg_min(url, lpad(CAST(diff AS VARCHAR), 12, '0') || timestamp || digest) AS url,
  min(diff) AS diff_seconds
FROM (SELECT *, abs(date_diff('second', strptime('20240115120000', '%Y%m%d%H%M%S'), strptime(timestamp, '%Y%m%d%H%M%S'))) AS diff FROM cdx)
GROUP BY url""")
def q_closest_capture(spark, d):
    users = TB.read_table(spark, d, "events").select("user_id").distinct()
    req = users.select(F.col("user_id").alias("req_id"),
                       F.concat(F.lit("http://www.site"), (F.col("user_id") % 7).cast("string"),
                                F.lit(".example.pt/u/"), F.col("user_id").cast("string")).alias("url"),
                       F.lit("20240115120000").alias("tstamp"))
    return C.closest_capture(req, TB.cdx_captures(spark, d))


# ------------------------------------------------------------------ point lookups

def doc_cdx(spark, d) -> DataFrame:
    """Capture rows of the captured documents (so text hits and captures can meet)."""
    c = TB.document_captures(spark, d)
    n = TB.read_table(spark, d, "documents").select("doc_id", "n_chars")
    c = c.join(n, "doc_id")
    return c.select(
        "url", F.col("tstamp").alias("timestamp"), "digest", F.col("type").alias("mime"), F.lit("200").alias("status"),
        F.concat(F.lit("DOC-"), F.col("collection"), F.lit(".warc.gz")).alias("filename"),
        F.col("n_chars").cast("string").alias("length"), (F.col("doc_id") * 512).cast("string").alias("offset"),
        F.when(F.col("doc_id") % 4 == 0, F.lit("")).otherwise(
            F.concat(F.lit("cdx"), (F.col("doc_id") % 2).cast("string"))).alias("collection"))


def _meta_requests(spark, d) -> DataFrame:
    dc = TB.document_captures(spark, d).select(F.col("doc_id").alias("req_id"), F.concat_ws("/", "url", "tstamp").alias("id"))
    ev = TB.read_table(spark, d, "events").select(
        (F.lit(-1) - F.col("event_id")).alias("req_id"),
        F.concat(F.lit("http://www.site"), (F.col("user_id") % 7).cast("string"), F.lit(".example.pt/u/"),
                 F.col("user_id").cast("string"), F.lit("/"),
                 F.when(F.col("event_id") % 11 == 0, F.lit("19990101000000")).otherwise(TS.ts14("ts"))).alias("id"))
    return dc.unionByName(ev)


_META_SQL = O.with_ctes(O.CORPUS[0], ("vdocs", O.VERSION_DOCS), ("doc_cdx", O.DOC_CDX), ("ev_cdx", O.CDX),
                        ("all_cdx", "SELECT * FROM doc_cdx UNION ALL SELECT * FROM ev_cdx"),
                        ("req", f"""SELECT doc_id AS req_id, url, tstamp AS ts FROM doc_captures
  UNION ALL SELECT -1 - event_id AS req_id,
    'http://www.site' || CAST(user_id % 7 AS VARCHAR) || '.example.pt/u/' || CAST(user_id AS VARCHAR) AS url,
    CASE WHEN event_id % 11 = 0 THEN '19990101000000' ELSE {O.ts14('ts')} END AS ts FROM events"""),
                        ("txt", """SELECT r.req_id, min(c.digest) AS doc_id, arg_min(c.collection, c.digest) AS vcollection
  FROM req r JOIN doc_captures c ON c.url = r.url AND c.tstamp = r.ts GROUP BY r.req_id"""),
                        ("cx", """SELECT r.req_id,
    arg_min(TRY_CAST(x.status AS INTEGER), x.digest || lpad(x."offset", 20, '0')) AS statusCode,
    arg_min(TRY_CAST(x.length AS BIGINT), x.digest || lpad(x."offset", 20, '0')) AS contentLength,
    arg_min(TRY_CAST(x."offset" AS BIGINT), x.digest || lpad(x."offset", 20, '0')) AS "offset",
    arg_min(x.filename, x.digest || lpad(x."offset", 20, '0')) AS fileName,
    arg_min(x.digest, x.digest || lpad(x."offset", 20, '0')) AS digest,
    arg_min(x.collection, x.digest || lpad(x."offset", 20, '0')) AS collection,
    arg_min(x.mime, x.digest || lpad(x."offset", 20, '0')) AS mime
  FROM req r JOIN all_cdx x ON x.url = r.url AND x.timestamp = r.ts GROUP BY r.req_id"""),
                        body="""SELECT r.req_id, t.req_id IS NOT NULL AS found_text, c.req_id IS NOT NULL AS found_cdx,
  v.titleString AS title,
  CASE WHEN t.req_id IS NOT NULL THEN v.type ELSE c.mime END AS mimeType,
  CASE WHEN t.req_id IS NOT NULL AND c.req_id IS NOT NULL AND coalesce(c.collection, '') <> '' THEN c.collection
       WHEN t.req_id IS NOT NULL THEN t.vcollection ELSE c.collection END AS collection,
  c.statusCode, c.contentLength, c."offset", c.fileName,
  CASE WHEN c.req_id IS NOT NULL THEN c.digest ELSE t.doc_id END AS digest
FROM req r LEFT JOIN txt t ON t.req_id = r.req_id LEFT JOIN cx c ON c.req_id = r.req_id
LEFT JOIN vdocs v ON v.id = t.doc_id
WHERE t.req_id IS NOT NULL OR c.req_id IS NOT NULL""")


@register("metadata_merge", _META_SQL)
def q_metadata_merge(spark, d):
    caps = TB.cdx_captures(spark, d).unionByName(doc_cdx(spark, d))
    return M.metadata(_meta_requests(spark, d), corpus_docs(spark, d), corpus_versions(spark, d), caps)


@register("extracted_text", O.with_ctes(O.CORPUS[0], ("vdocs", O.VERSION_DOCS), body="""
SELECT c.doc_id AS req_id, v.id IS NOT NULL AS found, v.id AS doc_id,
  CASE WHEN v.id IS NOT NULL THEN coalesce(v.titleString, '') || ', ' || coalesce(v.content, '') END AS text
FROM doc_captures c LEFT JOIN vdocs v ON v.id = c.digest AND c.doc_id % 5 > 1"""))
def q_extracted_text(spark, d):
    """Requests for every capture; of five one has another time and one is no URL."""
    time = F.when(F.col("doc_id") % 5 == 0, F.lit("19990101000000")).otherwise(F.col("tstamp"))
    url = F.when(F.col("doc_id") % 5 == 1, F.lit("no url")).otherwise(F.col("url"))
    req = TB.document_captures(spark, d).select(F.col("doc_id").alias("req_id"), F.concat_ws("/", url, time).alias("id"))
    return M.extracted_text(req, corpus_docs(spark, d), corpus_versions(spark, d))


@register("exact_version", O.with_ctes(O.CORPUS[0], body="""
SELECT doc_id AS req_id, digest AS doc_id FROM doc_captures"""))
def q_exact_version(spark, d):
    dc = TB.document_captures(spark, d)
    req = dc.select(F.col("doc_id").alias("req_id"),
                    F.concat_ws(",", "url", F.lit("term1 term2"), F.regexp_replace("url", "^http://", "https://")).alias("urls"),
                    "tstamp")
    return M.version_lookup(req, corpus_versions(spark, d)).select("req_id", "doc_id")


from archivesearch.plans import archive_queries  # noqa: E402, F401
