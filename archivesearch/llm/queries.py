"""The registered queries of the operators, with their production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from archivesearch.llm import license_scan as licenses
from archivesearch.llm import (chat, decontaminate, hard_negatives, line_dedup, packing, quality, simhash, token_store, toxicity,
                               url_filter, vector_codes, warc)
from archivesearch.llm.shared import shared_path

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.find_leaks(docs, _table(spark, sf_dir, "benchmark"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    path = shared_path(spark, "token_store")
    token_store.write_store(docs, path, TOKENIZER, end_id=2)
    return token_store.digest(spark, path)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.license_scan(docs).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).select(
        "doc_id", simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id")


def op6_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality(docs).select("doc_id", *quality.COLUMNS)


def op7_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.digest(packing.bucketed(docs, TOKENIZER, end_id=1, max_length=2048))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "spans")


def op9_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "archives")
    warc.write_archives(_table(spark, sf_dir, "pages"), path)
    return warc.digest(warc.assemble(warc.read_archives(spark, path, payloads=False)))


def _captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages with a fetch day within four years, dealt out by page_id."""
    day = F.date_add(F.lit("2020-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(1461)).cast("int"))
    return _table(spark, sf_dir, "pages").select("page_id", "url", day.alias("fetched"))


def _list_entries(captures: DataFrame) -> DataFrame:
    """Dated entries of three lists, made from the hosts of the captures by a hash of the value:
    domains blocked for a while (some again later), hosts allowed, language folders blocked."""
    hosts = captures.select(url_filter.host_of(F.col("url")).alias("host")).filter("host is not null").distinct()
    domains = hosts.select(F.expr("substring_index(host, '.', -3)").alias("value")).distinct()
    folders = hosts.select(F.explode(F.array(*[F.concat("host", F.lit(f"/{x}")) for x in ("en", "de")])).alias("value"))

    def h(salt: str):
        return F.conv(F.substring(F.md5(F.concat(F.lit(salt), "value").cast("binary")), 1, 6), 16, 10).cast("int")

    def entry(rows: DataFrame, name: str, action: str, kind: str, event: str, days, where) -> DataFrame:
        day = F.date_add(F.lit("2020-01-01").cast("date"), days.cast("int"))
        return rows.filter(where).select(F.lit(name).alias("list_name"), F.lit(action).alias("action"), F.lit(kind).alias("kind"),
                                         "value", F.lit(event).alias("event"), day.alias("day"))

    begin, stay = h("d") % 700, 200 + h("s") % 300
    parts = [entry(domains, "ads", "block", "domain", "add", begin, h("a") % 3 == 0),
             entry(domains, "ads", "block", "domain", "remove", begin + stay, h("a") % 3 == 0),
             entry(domains, "ads", "block", "domain", "add", begin + stay + 150, h("a") % 6 == 0),
             entry(domains, "spam", "block", "domain", "add", begin + 60, h("a") % 2 == 0),
             entry(hosts.withColumnRenamed("host", "value"), "partners", "allow", "host", "add", h("p") % 900, h("q") % 4 == 0),
             entry(folders, "folders", "block", "prefix", "add", h("f") % 1000, h("g") % 5 == 0)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = _captures(spark, sf_dir)
    return url_filter.filter_urls(captures, _list_entries(captures)).withColumn("fetched", F.col("fetched").cast("string"))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], rows.schema)
    return chat.digest(rows.unionByName(more), TOKENIZER)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, book = vector_codes.fit(_table(spark, sf_dir, "embeddings"))
    return vector_codes.digest(codes, book)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0).drop("anchor_row")


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_token_store": op3_token_store,
    "op4_license_scan": op4_license_scan,
    "op5_simhash": op5_simhash,
    "op6_compression_bands": op6_compression_bands,
    "op7_binary_packing": op7_binary_packing,
    "op8_toxicity": op8_toxicity,
    "op9_warc_transactions": op9_warc_transactions,
    "op10_url_filters": op10_url_filters,
    "op11_chat_format": op11_chat_format,
    "op12_vector_codes": op12_vector_codes,
    "op13_hard_negatives": op13_hard_negatives,
}

_KEY = "translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_VECTORS = """
kept as (
  select vec_id, label, list_transform(embedding, lambda x: cast(floor(cast(x as double) * 256) as bigint)) as v
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)"""


def _lloyd() -> str:
    """Two rounds and the last assignment of the codebooks as one chain of tables."""
    steps = []
    for n in range(3):
        steps.append(f"""a{n} as materialized (
  select p.vec_id, p.label, p.pos, p.v, b.entry, list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - b.v[i]) * (p.v[i] - b.v[i]))) as far
  from parts p join b{n} b using (pos)
  qualify row_number() over (partition by p.vec_id, p.pos order by far, b.entry) = 1)""")
        if n < 2:
            steps.append(f"""m{n} as (
  select pos, entry, list(mean order by i) as v
  from (select pos, entry, i, cast(floor(sum(v[i]) / count(*)) as bigint) as mean from a{n}, range(1, 5) t(i) group by all) group by pos, entry),
b{n + 1} as materialized (select b.pos, b.entry, coalesce(m.v, b.v) as v from b{n} b left join m{n} m using (pos, entry))""")
    return ",\n".join(steps)


def _marks(text: str) -> str:
    """Characters that escaping adds to a text: one for each control string, with backslashes in it or not."""
    return f"len(regexp_extract_all({text}, '<\\\\*(s>|/s>|\\|endoftext\\|>)|\\[\\\\*/?(INST|ROLE)\\]'))"


ORACLES: dict[str, str] = {
    "op11_chat_format": f"""
with c as (
  select conv_id, turn, role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
       cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn) filter (where role = 'assistant'), '')) as loss_sha256,
       cast(sum(length(text) + {_marks('text')} + case role when 'user' then 13 when 'assistant' then 4 else 17 + length(role) + {_marks('role')} end)
            as bigint) as formatted_chars
from c group by conv_id""",
    "op12_vector_codes": f"""
with {_VECTORS},
parts as materialized (select vec_id, label, pos, v[pos * 4 + 1 : pos * 4 + 4] as v from kept, range(16) t(pos)),
b0 as materialized (
  select pos, v, dense_rank() over (order by vec_id) - 1 as entry from parts
  where vec_id in (select distinct vec_id from kept order by vec_id limit 64)),
{_lloyd()},
coded as (
  select vec_id, label, string_agg(lpad(lower(hex(entry)), 2, '0'), '' order by pos) as code, cast(sum(far) as bigint) as error
  from a2 group by vec_id, label),
book as (select sha256(string_agg(list_aggregate(v, 'string_agg', ','), ',' order by pos, entry)) as codebooks_sha256 from b2)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256
from coded, book""",
    "op13_hard_negatives": f"""
with {_VECTORS},
r as materialized (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, v from kept where label is not null),
pairs as materialized (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same,
         list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) as score
  from r a join r b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
positives as (
  select *, row_number() over (partition by anchor_id order by score desc, vec_id) as positive_rank from pairs where same
  qualify positive_rank <= 5),
hits as (
  select p.anchor_id, p.vec_id as positive_id, n.vec_id as negative_id, p.score as positive_score, n.score as negative_score, p.positive_rank,
         row_number() over (partition by p.anchor_id, p.vec_id order by n.score desc, n.vec_id) as rank
  from positives p join pairs n on n.anchor_id = p.anchor_id and not n.same
       and 80 * p.score <= 100 * n.score and 100 * n.score <= 100 * p.score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, cast(positive_score as bigint) as positive_score,
       cast(negative_score as bigint) as negative_score, cast(positive_rank as integer) as positive_rank
from hits where rank <= 5""",
    "op1_line_dedup": f"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos
  from documents),
keyed as (select doc_id, pos, line, {_KEY} as k from lines),
repeated as (
  select k, max(doc_id) as owner from keyed
  where length(k) >= 40 group by k having count(distinct doc_id) >= 5),
marked as (
  select keyed.*, coalesce(keyed.doc_id <> owner, false) as gone
  from keyed left join repeated on keyed.k = repeated.k)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id""",
    "op9_warc_transactions": """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
q as (select *, min(page_id) over (partition by payload_digest) as first_id from p)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 100 and page_id <> first_id then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and page_id <> first_id then first_id end as refers_to
from q""",
    "op10_url_filters": r"""
with c as (
  select page_id, url, date '2020-01-01' + cast((page_id * 37) % 1461 as integer) as fetched,
         nullif(regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^.*@', ''), '\.*(:[0-9]*)?$', ''), '') as host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) as path
  from pages),
hosts as (select distinct host as value from c where host is not null),
domains as (select distinct array_to_string(list_slice(string_split(value, '.'), -3, -1), '.') as value from hosts),
folders as (select value || f as value from hosts, (values ('/en'), ('/de')) t(f)),
src as (select 'domain' as kind, value from domains union all select 'host', value from hosts union all select 'prefix', value from folders),
hashed as (
  select kind, value, cast('0x' || substr(md5('a' || value), 1, 6) as integer) as a, cast('0x' || substr(md5('d' || value), 1, 6) as integer) as d,
         cast('0x' || substr(md5('s' || value), 1, 6) as integer) as s, cast('0x' || substr(md5('p' || value), 1, 6) as integer) as p,
         cast('0x' || substr(md5('q' || value), 1, 6) as integer) as q, cast('0x' || substr(md5('f' || value), 1, 6) as integer) as f,
         cast('0x' || substr(md5('g' || value), 1, 6) as integer) as g
  from src),
valid as (
  select 'ads' as list_name, 'block' as action, kind, value, d % 700 as lo, d % 700 + 200 + s % 300 as hi from hashed where kind = 'domain' and a % 3 = 0
  union all select 'ads', 'block', kind, value, d % 700 + 350 + s % 300, null from hashed where kind = 'domain' and a % 6 = 0
  union all select 'spam', 'block', kind, value, d % 700 + 60, null from hashed where kind = 'domain' and a % 2 = 0
  union all select 'partners', 'allow', kind, value, p % 900, null from hashed where kind = 'host' and q % 4 = 0
  union all select 'folders', 'block', kind, value, f % 1000, null from hashed where kind = 'prefix' and g % 5 = 0),
hits as (
  select c.page_id, c.url, c.fetched, v.*
  from c join valid v on (c.host = v.value and v.kind in ('host', 'domain') or v.kind = 'domain' and ends_with(c.host, '.' || v.value)
                          or v.kind = 'prefix' and starts_with(c.host || rtrim(c.path, '/') || '/', v.value || '/'))
  where c.fetched - date '2020-01-01' >= v.lo and (v.hi is null or c.fetched - date '2020-01-01' < v.hi)),
grouped as (
  select page_id, kind, value, action, string_agg(distinct list_name, ',' order by list_name) as lists
  from hits group by all),
best as (
  select *, row_number() over (partition by page_id order by case kind when 'prefix' then 3 when 'host' then 2 else 1 end desc,
                               length(value) desc, action) as r
  from grouped)
select c.page_id, c.url, cast(c.fetched as varchar) as fetched, coalesce(b.action, 'allow') as verdict, b.kind as matched_kind, b.value as matched_value, b.lists as matched_lists
from c left join best b on b.page_id = c.page_id and b.r = 1""",
}
