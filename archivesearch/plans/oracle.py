"""DuckDB SQL that independently recomputes each registered query (the correctness gate).

The SQL reads the driver's pre-registered views (``pages``, ``documents``, ``events``,
``lineitem``, ``part``, ``benchmark``) and re-derives the archive tables of
``sources/tables.py``. URL and timestamp rules are written as chained select-list
aliases (DuckDB lets a select item use an earlier alias).
"""

from __future__ import annotations

# Scheme, authority, path, query, fragment of a URL; the core of the URL test.
URL_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
URL_CORE = r"[a-zA-Z0-9][-\w.]+\.[a-z.]{2,6}"
AUTH = r"^(?:[^@]*@)?([^:]*)(:[0-9]*)?$"
TOKEN = r"[\p{L}\p{N}]+"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


Layers = list  # list of layers; a layer is a list of (alias, expr) over earlier columns only


def lay(base: str, *steps: Layers) -> str:
    """Nest ``base`` in one ``SELECT *, ...`` per layer (no alias is re-expanded)."""
    sql = base
    n = 0
    for step in steps:
        for layer in step:
            items = ", ".join(f"{e} AS {a}" for a, e in layer)
            sql = f"SELECT *, {items} FROM ({sql}) _l{n}"
            n += 1
    return sql


def canonical(src: str, out: str, p: str) -> Layers:
    """F3 of ``src`` into ``out`` (helper columns prefixed ``p``)."""
    P = q(URL_PARTS)
    return [
        [(f"{p}_u", f"CASE WHEN {src} LIKE '<%>' AND length({src}) >= 2 THEN substr({src}, 2, length({src}) - 2) ELSE {src} END")],
        [(f"{p}_s", f"regexp_replace({p}_u, '/$', '')")],
        [(f"{p}_m", f"regexp_matches({p}_s, {P})"), (f"{p}_scheme", f"lower(regexp_extract({p}_s, {P}, 1))"),
         (f"{p}_auth", f"regexp_extract({p}_s, {P}, 2)"), (f"{p}_path0", f"regexp_extract({p}_s, {P}, 3)"),
         (f"{p}_query", f"regexp_extract({p}_s, {P}, 4)"), (f"{p}_frag", f"regexp_extract({p}_s, {P}, 5)")],
        [(f"{p}_ui", f"regexp_extract({p}_auth, '^([^@]*@)?', 1)"),
         (f"{p}_host", f"lower(regexp_extract({p}_auth, {q(AUTH)}, 1))"),
         (f"{p}_port0", f"regexp_extract({p}_auth, {q(AUTH)}, 2)")],
        [(f"{p}_port", f"""CASE WHEN {p}_port0 = ':' OR {p}_port0 = (CASE {p}_scheme WHEN 'http' THEN ':80' WHEN 'https' THEN ':443'
            WHEN 'ws' THEN ':80' WHEN 'wss' THEN ':443' WHEN 'ftp' THEN ':21' ELSE '' END) THEN '' ELSE {p}_port0 END"""),
         (f"{p}_path", f"""CASE WHEN {p}_path0 = '' THEN '/' ELSE
            array_to_string(list_reduce(string_split({p}_path0, '/'),
              lambda acc, x: CASE WHEN x = '.' THEN acc WHEN x = '..' THEN (CASE WHEN len(acc) > 1 THEN acc[1:len(acc) - 1] ELSE acc END)
                             ELSE list_append(acc, x) END, []::VARCHAR[]), '/')
            || CASE WHEN regexp_matches({p}_path0, '/\\.\\.?$') THEN '/' ELSE '' END END""")],
        [(out, f"""CASE WHEN {src} IS NULL OR {src} = '' THEN NULL
            WHEN {p}_m THEN {p}_scheme || '://' || {p}_ui || {p}_host || {p}_port || {p}_path || {p}_query || {p}_frag
            ELSE {p}_s END""")],
    ]


def strip_www(src: str, out: str, p: str) -> Layers:
    """F2."""
    return [
        [(f"{p}_s1", f"regexp_replace({src}, '/$', '')")],
        [(f"{p}_a", f"CASE WHEN regexp_matches({p}_s1, '^\\w+://') THEN regexp_replace({p}_s1, '^\\w+://', '') ELSE {src} END")],
        [(f"{p}_s2", f"regexp_replace({p}_a, '/$', '')")],
        [(out, f"CASE WHEN regexp_matches({p}_s2, '^www[0-9]*\\.') THEN regexp_replace({p}_s2, '^www[0-9]*\\.', '') ELSE {p}_a END")],
    ]


def surt_of_stripped(src: str, out: str, p: str) -> Layers:
    return [
        [(f"{p}_hp", f"regexp_extract({src}, '^([^/?#]*)', 1)")],
        [(f"{p}_rest", f"substr({src}, length({p}_hp) + 1)"), (f"{p}_h", f"regexp_extract({p}_hp, '^([^:]*)', 1)"),
         (f"{p}_pt", f"regexp_extract({p}_hp, '(:[0-9]*)$', 1)")],
        [(f"{p}_head", f"""'(' || CASE WHEN regexp_matches({p}_h, '^[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+$') THEN {p}_h
            ELSE array_to_string(list_reverse(string_split({p}_h, '.')), ',') END || ',' || {p}_pt""")],
        [(out, f"CASE WHEN {p}_rest = '' THEN {p}_head ELSE {p}_head || ')' || {p}_rest END")],
    ]


def surt(src: str, out: str, p: str) -> Layers:
    """canonical -> strip -> SURT."""
    return (canonical(src, f"{p}_c", f"{p}c") + strip_www(f"{p}_c", f"{p}_st", f"{p}w")
            + surt_of_stripped(f"{p}_st", out, f"{p}s"))


def surt_to_url(src: str, out: str, p: str) -> Layers:
    """F5."""
    return [
        [(f"{p}_o", f"instr({src}, '(')"), (f"{p}_cl", f"instr({src}, ')')")],
        [(f"{p}_ch", f"""CASE WHEN {p}_cl = 0 AND instr({src}, '/') = 0
            THEN 'https://' || array_to_string(list_reverse(list_filter(string_split(substr({src}, {p}_o + 1), ','), lambda x: length(x) > 0)), '.')
            WHEN {p}_o > 0 AND {p}_cl > 0
            THEN 'https://' || array_to_string(list_reverse(list_filter(string_split(substr({src}, {p}_o + 1, {p}_cl - {p}_o - 1), ','), lambda x: length(x) > 0)), '.') || substr({src}, {p}_cl + 1)
            ELSE {src} END""")],
    ] + canonical(f"{p}_ch", out, f"{p}k")


def canonical_ts(src: str, out: str, p: str) -> Layers:
    """F8."""
    d = "19910101000000"
    parts = [("y", 1, 4), ("mo", 5, 2), ("d", 7, 2), ("h", 9, 2), ("mi", 11, 2), ("se", 13, 2)]
    return [
        [(f"{p}_r", f"""CASE WHEN NOT regexp_matches({src}, '^[0-9]*$') THEN '{d}'
            ELSE substr({src}, 1, 14) || substr('{d}', length({src}) + 1, 14) END""")],
        [(f"{p}_{n}", f"CAST(substr({p}_r, {a}, {b}) AS INTEGER)") for n, a, b in parts],
        [(out, f"""lpad(CAST(CASE WHEN {p}_y < 1991 OR {p}_y > 9999 THEN 1991 ELSE {p}_y END AS VARCHAR), 4, '0')
            || lpad(CAST(CASE WHEN {p}_mo < 1 OR {p}_mo > 12 THEN 1 ELSE {p}_mo END AS VARCHAR), 2, '0')
            || lpad(CAST(CASE WHEN {p}_d < 1 OR {p}_d > 31 THEN 1 ELSE {p}_d END AS VARCHAR), 2, '0')
            || lpad(CAST(CASE WHEN {p}_h > 23 THEN 0 ELSE {p}_h END AS VARCHAR), 2, '0')
            || lpad(CAST(CASE WHEN {p}_mi > 59 THEN 0 ELSE {p}_mi END AS VARCHAR), 2, '0')
            || lpad(CAST(CASE WHEN {p}_se > 59 THEN 0 ELSE {p}_se END AS VARCHAR), 2, '0')""")],
    ]


def ts14(expr: str) -> str:
    return f"strftime({expr}, '%Y%m%d%H%M%S')"


def tokens(expr: str) -> str:
    return f"regexp_extract_all(lower({expr}), {q(TOKEN)})"


# ----------------------------------------------------------------- derived tables (CTE bodies)

CAPTURED_PAGES = f"""SELECT page_id, url, html,
  {ts14("TIMESTAMP '2024-01-01 00:00:00' + to_hours(page_id)")} AS tstamp,
  'col' || CAST(page_id % 3 AS VARCHAR) AS collection
FROM pages"""

RECORDS = f"""SELECT event_id AS record_id,
  CASE WHEN event_type IN ('view', 'click') THEN 'response' WHEN event_type = 'purchase' THEN 'revisit'
       WHEN event_type = 'signup' THEN 'request' END AS record_type,
  CASE WHEN event_id % 50 = 0 THEN NULL
       WHEN event_id % 50 = 1 THEN 'ftp://files.example.pt/u/' || CAST(user_id AS VARCHAR)
       ELSE 'http://www.site' || CAST(user_id % 7 AS VARCHAR) || '.example.pt/u/' || CAST(user_id AS VARCHAR) END AS url,
  CASE WHEN event_id % 40 = 3 THEN NULL
       ELSE (['200', '200', '301', '404', '206', '500'])[CAST(floor(value) AS BIGINT) % 6 + 1] END AS status,
  CASE WHEN event_id % 9 = 4 THEN NULL
       ELSE (['text/html; charset=utf-8', 'text/plain', 'application/pdf', 'text/css', 'application/javascript',
              'image/png', 'TEXT/HTML', 'text/'])[event_id % 8 + 1] END AS content_type,
  {ts14("ts")} AS tstamp
FROM events"""

EDGES = f"""SELECT 'http://s' || CAST(l_suppkey AS VARCHAR) || '.example.com/o/' || CAST(l_orderkey AS VARCHAR) AS from_url,
  'http://www.example.com/p/' || CAST(l_partkey AS VARCHAR) || '/' AS to_url,
  CASE WHEN l_linenumber = 1 THEN '' ELSE l_returnflag || l_linestatus END AS anchor,
  {ts14("l_shipdate")} AS tstamp,
  'li-' || CAST(l_orderkey % 16 AS VARCHAR) || '.warc.gz' AS warc_name,
  l_orderkey * 8 + l_linenumber AS warc_offset
FROM (SELECT * FROM lineitem UNION ALL
      SELECT * REPLACE (l_shipdate + INTERVAL 7 DAYS AS l_shipdate) FROM lineitem WHERE l_orderkey % 3 = 0)"""

CDX = f"""SELECT 'http://www.site' || CAST(user_id % 7 AS VARCHAR) || '.example.pt/u/' || CAST(user_id AS VARCHAR) AS url,
  {ts14("ts")} AS timestamp,
  upper(md5(props)) AS digest,
  CASE WHEN event_type IN ('view', 'click') THEN 'text/html' WHEN event_type = 'purchase' THEN 'application/pdf'
       WHEN event_type = 'signup' THEN 'text/plain' ELSE 'image/png' END AS mime,
  CASE WHEN event_type = 'error' THEN NULL ELSE CAST(200 + 100 * (CAST(floor(value) AS BIGINT) % 4) AS VARCHAR) END AS status,
  'EV-' || strftime(ts, '%Y%m%d') || '.warc.gz' AS filename,
  CASE WHEN event_id % 25 = 0 THEN NULL ELSE CAST(length(props) * 97 AS VARCHAR) END AS length,
  CAST(event_id * 1000 AS VARCHAR) AS "offset",
  CASE WHEN user_id % 5 = 0 THEN '' ELSE 'col' || CAST(user_id % 3 AS VARCHAR) END AS collection
FROM events"""

DOC_CAPTURES = "SELECT doc_id, url, surt, site, title, content, digest, tstamp, collection, type, lang, n_chars FROM (" + lay(
    f"""SELECT doc_id, 'http://www.' || source || '.example.org/d/' || CAST(doc_id AS VARCHAR) AS url,
    source AS site,
    split_part(text, chr(10), 1) AS title,
    text AS content,
    upper(md5(text)) AS digest,
    {ts14("TIMESTAMP '2015-01-01 00:00:00' + to_minutes(doc_id * 437)")} AS tstamp,
    'col' || CAST(doc_id % 3 AS VARCHAR) AS collection,
    (['text/html', 'text/html', 'text/plain', 'application/pdf', 'application/msword'])[doc_id % 5 + 1] AS type,
    lang, n_chars FROM documents""", surt("url", "surt", "dc")) + ")"

# Version documents (A6): one per digest; the oldest capture is the min of time, collection, SURT, URL.
VERSION_DOCS = """SELECT digest AS id,
  arg_min(title, tstamp || collection || surt || url) AS titleString,
  arg_min(content, tstamp || collection || surt || url) AS content,
  arg_min(type, tstamp || collection || surt || url) AS type,
  arg_min(surt, tstamp || collection || surt || url) AS surtOldest,
  arg_min(collection, tstamp || collection || surt || url) AS collection,
  arg_min(url, tstamp || collection || surt || url) AS urlOldest,
  min(tstamp) AS tstampOldest, max(tstamp) AS tstampLatest,
  count(*) AS captures,
  string_agg(DISTINCT collection || '/' || tstamp || '/' || surt, ' ' ORDER BY collection || '/' || tstamp || '/' || surt) AS versions
FROM doc_captures GROUP BY digest"""

WORKLOAD = f"""SELECT item_id AS qid, list_filter(t, lambda x, i: list_position(t, x) = i) AS terms,
  t AS all_tokens
FROM (SELECT item_id, {tokens("text")} AS t FROM benchmark)"""

# Token rows of the corpus: (doc_id, field, term, pos, field_len)
FIELD_TOKENS = f"""SELECT id AS doc_id, 'title' AS field, {tokens("coalesce(titleString, '')")} AS toks FROM vdocs
UNION ALL SELECT id AS doc_id, 'content' AS field, {tokens("coalesce(content, '')")} AS toks FROM vdocs"""

POSTINGS = """SELECT doc_id, field, term, count(*) AS tf, any_value(field_len) AS field_len FROM (
  SELECT doc_id, field, len(toks) AS field_len, unnest(toks) AS term FROM field_tokens)
GROUP BY doc_id, field, term"""

FIELD_STATS = """SELECT field, count(*) AS n_docs, avg(len(toks)) AS avg_len FROM field_tokens GROUP BY field"""
TERM_STATS = """SELECT term, field, count(*) AS df FROM postings GROUP BY term, field"""


def with_ctes(*ctes: tuple[str, str], body: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({s})" for n, s in ctes) + "\n" + body


CORPUS = [("doc_captures", DOC_CAPTURES), ("vdocs", VERSION_DOCS), ("field_tokens", FIELD_TOKENS),
          ("postings", POSTINGS), ("field_stats", FIELD_STATS), ("term_stats", TERM_STATS)]


def bm25_scores(qterms_cte: str, operator: str = "or") -> str:
    """Per (qid, doc_id): rounded BM25 over title (x2) and content, of any (or all) ``qterms``."""
    having = "HAVING count(DISTINCT p.term) = any_value(n.n_terms)" if operator == "and" else ""
    return f"""SELECT t.qid, p.doc_id,
    round(sum(CASE p.field WHEN 'title' THEN 2.0 ELSE 1.0 END
      * ln(1.0 + (fs.n_docs - ts.df + 0.5) / (ts.df + 0.5))
      * p.tf * (1.2 + 1) / (p.tf + 1.2 * (1 - 0.75 + 0.75 * p.field_len / fs.avg_len))), 6) AS score
  FROM {qterms_cte} t JOIN postings p ON p.term = t.term
  JOIN term_stats ts ON ts.term = p.term AND ts.field = p.field
  JOIN field_stats fs ON fs.field = p.field
  JOIN (SELECT qid, count(DISTINCT term) AS n_terms FROM {qterms_cte} GROUP BY qid) n ON n.qid = t.qid
  GROUP BY t.qid, p.doc_id {having}"""


DOC_CDX = f"""SELECT url, tstamp AS timestamp, digest, type AS mime, '200' AS status,
  'DOC-' || collection || '.warc.gz' AS filename, CAST(n_chars AS VARCHAR) AS length,
  CAST(doc_id * 512 AS VARCHAR) AS "offset",
  CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'cdx' || CAST(doc_id % 2 AS VARCHAR) END AS collection
FROM doc_captures"""

# Workload terms as rows: (qid, term)
QTERMS = "SELECT qid, unnest(terms) AS term FROM workload"


def ranked_search(params: str, key: str, keep: str, off: str, offset: str, max_items: str) -> str:
    """Collapse + rank + page of matched, BM25-scored hits (no filters, no version cut).

    ``key``: SQL for the group key per hit (columns of vdocs available as d.*).
    """
    return f"""scored AS ({bm25_scores('qterms')}),
hits AS (SELECT s.qid, s.doc_id, s.score, {key} AS group_key FROM scored s JOIN vdocs d ON d.id = s.doc_id),
coll AS (SELECT *, row_number() OVER (PARTITION BY qid, group_key ORDER BY score DESC, doc_id) AS group_rank
         FROM hits WHERE {off} OR group_key IS NOT NULL),
kept AS (SELECT * FROM coll WHERE {off} OR group_rank <= greatest({keep}, 1)),
kept2 AS (SELECT qid, doc_id, score, CASE WHEN {off} THEN chr(0) || doc_id ELSE group_key END AS group_key,
                 CASE WHEN {off} THEN 1 ELSE group_rank END AS group_rank FROM kept),
heads AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM kept2 WHERE group_rank = 1),
page AS (SELECT * FROM heads WHERE rank > {offset} AND rank <= {offset} + {max_items}),
res AS (SELECT qid, doc_id, score, group_key, group_rank, rank FROM page
        UNION ALL SELECT k.qid, k.doc_id, k.score, k.group_key, k.group_rank, p.rank
        FROM kept2 k JOIN page p ON p.qid = k.qid AND p.group_key = k.group_key WHERE k.group_rank > 1)"""


def oldest_of(doc_alias: str = "doc_id") -> str:
    """Oldest version of each document from its captures: (id, o_tstamp, o_collection, o_surt)."""
    return """SELECT digest AS id, arg_min(tstamp, tstamp || collection || surt) AS o_tstamp,
  arg_min(collection, tstamp || collection || surt) AS o_collection,
  arg_min(surt, tstamp || collection || surt) AS o_surt
FROM doc_captures GROUP BY digest"""
