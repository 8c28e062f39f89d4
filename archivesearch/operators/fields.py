"""Fielded filters by keys (P22, P23): a registry that page search plans by what a batch uses.

A field filter says which keys a version of a document has and which keys a request's value
stands for; a version passes if they share one. The keys of all versions are stored with the corpus,
``(field, key, doc_id, version)`` in order of field and key, so every field of a batch is answered by
one equi-join with that table, and no query meets versions that share no key with it.

``register`` adds a filter; a request carries its values in an array column of the filter's name. Several values
are any-of; several fields hold for the same version.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivesearch.functions import urls as U
from archivesearch.functions.text import tokens
from archivesearch.session import stored, write_table

# Lengths of timestamp prefixes that a date can name: year, month, day, hour, minute, second.
DATE_LENGTHS = (4, 6, 8, 10, 12, 14)


@dataclass(frozen=True)
class FieldFilter:
    """``has(column of a version row)`` gives the keys of a version as an array, ``means(value)`` those of a request's value."""

    name: str
    column: str
    has: Callable[[Column], Column]
    means: Callable[[Column], Column]


FILTERS: dict[str, FieldFilter] = {}


def register(name: str, column: str, has: Callable[[Column], Column], means: Callable[[Column], Column]) -> FieldFilter:
    """Add (or replace) the filter of a request column. Corpora must be written after it to hold its keys."""
    if name in ("qid", "q", "site", "type", "collection", "title_search", "fields", "from", "to"):
        raise ValueError(f"{name!r} is a column of the query model")
    FILTERS[name] = FieldFilter(name, column, has, means)
    return FILTERS[name]


def _domains(host: Column) -> Column:
    """The host and every domain above it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


register("arcname", "warc_name", F.array, F.array)
register("exacturl", "url", lambda c: F.array(U.url_key(c)), lambda v: F.array(U.url_key(v)))
register("exacturlexpand", "url", lambda c: F.array(U.url_key(c)), lambda v: F.transform(U.expand_url_variants(v), U.url_key))
register("domain", "url", lambda c: _domains(U.url_host(c)),
         lambda v: F.array(F.lower(F.regexp_replace(F.regexp_replace(v, U.SCHEME_RE, ""), r"[/:].*$", ""))))
register("date", "tstamp", lambda c: F.array(*[F.substring(c, 1, n) for n in DATE_LENGTHS]), lambda v: F.array(_digits(v)))
register("lang", "lang", lambda c: F.array(F.lower(c)), lambda v: F.array(F.lower(v)))
register("url_term", "url", lambda c: F.array_distinct(tokens(c)), tokens)


def version_key() -> Column:
    """A version of a document, as ``document_versions`` tells versions apart."""
    return F.xxhash64("collection", "tstamp", "surt")


def field_keys(captures: DataFrame) -> DataFrame:
    """``(field, key, doc_id, version)`` of captures (columns digest, collection, tstamp, surt and those that filters read;
    filters of columns that are not there have no keys)."""
    return _key_rows(captures).distinct()


def _key_rows(captures: DataFrame) -> DataFrame:
    known = [f for f in FILTERS.values() if f.column in captures.columns]
    per_field = [F.struct(F.lit(f.name).alias("field"), f.has(F.col(f.column)).alias("keys")) for f in known]
    rows = captures.select(F.col("digest").alias("doc_id"), version_key().alias("version"), F.explode(F.array(*per_field)).alias("f"))
    rows = rows.select(F.col("f.field").alias("field"), F.explode("f.keys").alias("key"), "doc_id", "version")
    return rows.filter("key is not null and key <> '' and doc_id is not null")


def write_field_keys(captures: DataFrame, path: str) -> None:
    """Stored in order of (field, key), a key that very many versions have over several files."""
    n = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    write_table(_key_rows(captures).repartitionByRange(n, "field", "key", "doc_id").distinct().sortWithinPartitions("field", "key"), path)


def used(requests: DataFrame) -> list[str]:
    """The filters whose columns a batch has."""
    return [name for name in FILTERS if name in requests.columns]


def asked_fields(requests: DataFrame) -> Column:
    """How many field filters a request uses; an empty list is no filter."""
    names = used(requests)
    if not names:
        return F.lit(0)
    return sum((F.when(F.coalesce(F.size(name), F.lit(0)) > 0, 1).otherwise(0) for name in names[1:]),
               F.when(F.coalesce(F.size(names[0]), F.lit(0)) > 0, 1).otherwise(0))


def matching_versions(aq: DataFrame, keys: DataFrame) -> DataFrame:
    """``(qid, doc_id, version)``: versions that pass all field filters of a query.

    A version with the keys that the batch asks for is one row, which meets a query by the keys of one field and is checked for the others
    there: pairs of queries and versions are neither held nor shuffled.
    """
    none = F.array().cast("array<struct<field:string,keys:array<string>>>")

    def values(f: FieldFilter) -> Column:
        keys = F.transform(F.col(f.name), lambda v: F.struct(F.lit(f.name).alias("field"), f.means(v).alias("keys")))
        return F.coalesce(keys, none)

    per_field = [values(FILTERS[name]) for name in used(aq)]
    asked = (aq.filter("n_fields > 0").select("qid", "n_fields", F.explode(F.concat(*per_field)).alias("f"))
             .select("qid", "n_fields", F.col("f.field").alias("field"), F.explode("f.keys").alias("key")).distinct())
    wanted = asked.groupBy("qid", "n_fields", "field").agg(F.collect_list("key").alias("keys"))
    wanted = wanted.groupBy("qid", "n_fields").agg(F.array_sort(F.collect_list(F.struct("field", "keys"))).alias("wanted"))
    # Queries by the keys of their first field; a field whose values mean no key leaves its query out.
    wanted = wanted.filter(F.size("wanted") == F.col("n_fields")).select(
        "qid", F.col("wanted")[0]["field"].alias("field"), F.col("wanted")[0]["keys"].alias("firsts"),
        F.slice("wanted", F.lit(2), F.size("wanted")).alias("rest"))
    starts = stored(wanted.withColumn("key", F.explode("firsts")), "starts")
    # Keys that some query asks for, dealt out by document: a row for each version with all of them.
    own = (keys.join(asked.select("field", "key").distinct(), ["field", "key"], "left_semi").groupBy("doc_id", "version")
           .agg(F.collect_set(F.struct("field", "key")).alias("own")))
    met = own.select("doc_id", "version", "own", F.explode("own").alias("k")).select("doc_id", "version", "own", "k.field", "k.key")
    met = met.join(starts, ["field", "key"])

    def has(field: Column, key: Column) -> Column:
        return F.array_contains("own", F.struct(field.alias("field"), key.alias("key")))

    # A version that has several keys of the first field meets its query at the first of them only.
    first = F.filter("firsts", lambda k: has(F.col("field"), k))[0] == F.col("key")
    return met.filter(first & F.forall("rest", lambda w: F.exists(w["keys"], lambda k: has(w["field"], k)))).select("qid", "doc_id", "version")
