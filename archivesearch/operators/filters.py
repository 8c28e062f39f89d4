"""Per-query document filters.

A filter is a predicate of document and query columns where both are at hand, or a table of
``(qid, doc_id)`` made by an equi-join on the filter's own keys (host, collection, type, title,
year); a query never meets all documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivesearch.functions import timestamps as TS
from archivesearch.functions import urls as U
from archivesearch.functions._util import col_of

# Type aliases and the MIME types each stands for.
TYPE_ALIASES = {
    "pdf": ["application/pdf"],
    "xls": ["application/vnd.ms-excel",
            "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"],
    "xlsx": ["application/vnd.ms-excel",
             "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"],
    "ppt": ["application/vnd.ms-powerpoint",
            "application/vnd.openxmlformats-officedocument.presentationml.presentation"],
    "pptx": ["application/vnd.ms-powerpoint",
             "application/vnd.openxmlformats-officedocument.presentationml.presentation"],
    "doc": ["application/msword",
            "application/vnd.openxmlformats-officedocument.wordprocessingml.document"],
    "docx": ["application/msword",
             "application/vnd.openxmlformats-officedocument.wordprocessingml.document"],
    "ps": ["application/postscript"],
    "ai": ["application/postscript"],
    "eps": ["application/postscript"],
    "htm": ["text/html"],
    "html": ["text/html"],
    "rtf": ["application/rtf"],
}


def _alias_map() -> Column:
    kv = []
    for k, v in TYPE_ALIASES.items():
        kv += [F.lit(k), F.array(*[F.lit(x) for x in v])]
    return F.create_map(*kv)


def canonical_bound(bound) -> Column:
    """Query bound as compared: F10 padding, then F8 canonicalisation (null stays null)."""
    b = col_of(bound)
    return F.when(b.isNull(), F.lit(None).cast("string")).otherwise(TS.canonical_timestamp(TS.bound_padding(b)))


def time_overlap(date_oldest, date_latest, lo, hi) -> Column:
    """The document's capture interval overlaps ``[lo, hi]`` (canonical bounds, null = open)."""
    f, t = col_of(lo), col_of(hi)
    return ((f.isNull() | (col_of(date_latest) >= f)) & (t.isNull() | (col_of(date_oldest) <= t)))


def site_prefixes(sites) -> Column:
    """SURT prefixes of the requested sites (domain only -> all sub-domains)."""
    return F.transform(col_of(sites), lambda s: U.surt(s))


# The labels of a SURT's host, up to the last comma before its port or path.
HOST_LABELS_RE = r"^(\((?:[^,)/]*,)*)"


def site_hits(aq: DataFrame, versions: DataFrame) -> DataFrame:
    """``(qid, doc_id)`` of documents with a SURT that starts with a site of the query.

    An equi-join on the host: the prefix's host labels must equal some leading labels of the
    document's; the prefix itself is compared on the pairs that leaves.
    """
    asked = (aq.select("qid", F.explode("prefixes").alias("prefix")).filter("prefix is not null")
             .withColumn("host", F.regexp_extract("prefix", HOST_LABELS_RE, 1)))
    labels = F.split(F.regexp_extract("surt", HOST_LABELS_RE, 1), ",")
    n = F.size(labels) - 1  # the last part, behind the last comma, is empty
    hosts = F.transform(F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")),
                        lambda i: F.concat(F.array_join(F.slice(labels, F.lit(1), i), ","), F.lit(",")))
    own = versions.select("doc_id", "surt").repartition("doc_id").distinct().withColumn("host", F.explode(hosts))
    return (own.join(asked, "host").filter(F.col("surt").startswith(F.col("prefix")))
            .select("qid", "doc_id").distinct())


def collection_hits(aq: DataFrame, versions: DataFrame) -> DataFrame:
    """``(qid, doc_id)`` of documents with a version in a collection of the query."""
    asked = aq.select("qid", F.explode("collection").alias("collection")).distinct()
    return versions.select("doc_id", "collection").repartition("doc_id").distinct().join(asked, "collection").select("qid", "doc_id").distinct()


def type_hits(aq: DataFrame, docs: DataFrame) -> DataFrame:
    """P12 from the types' side: the distinct types are spread to the words that select them
    (themselves, their parts, the aliases), joined with the query's words, then with documents."""
    asked = aq.select("qid", F.explode("type").alias("t")).select("qid", F.lower("t").alias("word")).distinct()
    types = docs.select("type").filter("type is not null").distinct()
    size = F.length("type")
    parts = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), size), lambda i: F.transform(
        F.sequence(F.lit(1), size - i + 1), lambda n: F.substring("type", i, n)))))
    # Words with a slash are whole types; aliases stand for their types only.
    free = F.filter(parts, lambda w: ~F.contains(w, F.lit("/")) & ~w.isin(*TYPE_ALIASES))
    known = F.concat(free, F.array("type"), F.filter(
        F.map_keys(_alias_map()), lambda a: F.array_contains(_alias_map()[a], F.col("type"))))
    words = types.filter(size > 0).select("type", F.explode(F.array_distinct(known)).alias("word"))
    chosen = words.join(asked, "word").select("qid", "type").distinct()
    return docs.select(F.col("id").alias("doc_id"), "type").repartition("doc_id").join(chosen, "type").select("qid", "doc_id")


def title_hits(aq: DataFrame, docs: DataFrame) -> DataFrame:
    """``(qid, doc_id)`` by equal title."""
    asked = aq.select("qid", F.col("title_search").alias("titleString")).dropna()
    return docs.select(F.col("id").alias("doc_id"), "titleString").join(asked, "titleString").select("qid", "doc_id")


def time_hits(aq: DataFrame, docs: DataFrame) -> DataFrame:
    """P7 as a join: documents and queries meet in the years that both cover."""
    year = lambda c: F.substring(c, 1, 4).cast("int")
    known = docs.select(F.col("id").alias("doc_id"), "tstampOldest", "tstampLatest").dropna()
    span = known.agg(F.min(year("tstampOldest")).alias("a"), F.max(year("tstampLatest")).alias("b")).first()
    first, last = span["a"] or 0, span["b"] or 0
    asked = aq.select("qid", "lo", "hi", F.greatest(F.coalesce(year("lo"), F.lit(first)), F.lit(first)).alias("y1"),
                      F.least(F.coalesce(year("hi"), F.lit(last)), F.lit(last)).alias("y2")).filter("y1 <= y2")
    asked = asked.select("qid", "lo", "hi", F.explode(F.sequence("y1", "y2")).alias("year"))
    own = known.repartition("doc_id").withColumn("year", F.explode(F.sequence(year("tstampOldest"), year("tstampLatest"))))
    return (own.join(asked, "year").filter(time_overlap("tstampOldest", "tstampLatest", "lo", "hi"))
            .select("qid", "doc_id").distinct())


def filter_only_hits(aq: DataFrame, docs: DataFrame, versions: DataFrame) -> DataFrame:
    """Documents of queries without terms, from one filter each (the first it has of site, title,
    collection, type, time); the others are applied to the hits like to any. Documents are dealt out by
    doc_id before they meet the queries (a small table), so that their pairs need no shuffle; filters that no query
    starts from are not planned."""
    site, title = F.col("prefixes").isNotNull(), F.col("title_search").isNotNull()
    coll, kind = F.col("collection").isNotNull(), F.col("type").isNotNull()
    ways = [(site, site_hits, versions), (~site & title, title_hits, docs), (~site & ~title & coll, collection_hits, versions),
            (~site & ~title & ~coll & kind, type_hits, docs), (~site & ~title & ~coll & ~kind, time_hits, docs)]
    asked = aq.agg(*[F.coalesce(F.max(of), F.lit(False)) for of, _, _ in ways]).first()
    parts = [hits(aq.filter(of), rows) for (of, hits, rows), some in zip(ways, asked) if some]
    return reduce(DataFrame.unionByName, parts) if parts else title_hits(aq, docs)


def title_filter(title_string, wanted) -> Column:
    """Exact title."""
    w = col_of(wanted)
    return w.isNull() | (col_of(title_string) == w)


def type_filter(doc_type, types) -> Column:
    """Full MIME (with ``/``) exact, alias -> MIME list, else substring; any-of, lower-cased."""
    ts = col_of(types)
    d = col_of(doc_type)
    amap = _alias_map()

    def one(t):
        tl = F.lower(t)
        aliased = amap[tl]
        return (F.when(F.instr(tl, "/") > 0, d == tl)
                .when(aliased.isNotNull(), F.array_contains(aliased, d))
                .otherwise(d.contains(tl)))

    return ts.isNull() | F.exists(ts, lambda t: F.coalesce(one(t), F.lit(False)))


def version_keeps(tstamp, surt, collection, lo, hi, prefixes, wanted) -> Column:
    """P10 for one version row: inside ``[lo, hi]``, under a wanted SURT prefix, in a wanted collection."""
    f, t, p, c = col_of(lo), col_of(hi), col_of(prefixes), col_of(wanted)
    ts, s = col_of(tstamp).cast("long"), col_of(surt)
    return ((p.isNull() | F.exists(p, lambda x: s.startswith(x)))
            & (f.isNull() | (ts >= f.cast("long"))) & (t.isNull() | (ts <= t.cast("long")))
            & (c.isNull() | F.array_contains(c, col_of(collection))))


def arcname_filter(warc_name, wanted) -> Column:
    """P22 ``arcname``."""
    return col_of(warc_name) == col_of(wanted)


def exact_url_filter(url, wanted) -> Column:
    """P22 ``exacturl``: same MD5 key as the requested URL."""
    return U.url_key(url) == U.url_key(wanted)


def domain_filter(site, domain) -> Column:
    """P22 ``domain``: the host is the domain or one of its sub-domains."""
    s, d = col_of(site), col_of(domain)
    return (s == d) | s.endswith(F.concat(F.lit("."), d))


def legacy_bounds(frm, to, start_date: str = "19960101000000", now: str | None = None):
    """Missing from -> configured start date, missing to -> now (14 digits)."""
    f = F.coalesce(col_of(frm), F.lit(start_date))
    t = F.coalesce(col_of(to), F.lit(now) if now else F.date_format(F.current_timestamp(), "yyyyMMddHHmmss"))
    return f, t


def strip_scheme(site) -> Column:
    """The legacy site filter drops the scheme."""
    return F.regexp_replace(col_of(site), r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
