"""The searchable corpus of the driver tables: stored once per application, read by every search."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivesearch.functions import urls as U
from archivesearch.operators.docs import document_versions, version_docs
from archivesearch.operators.fields import write_field_keys
from archivesearch.operators.index import Index, build_index
from archivesearch.session import PACKED, ensure_checkpoint_dir, path_exists, stored
from archivesearch.sources import tables as TB


@dataclass(frozen=True)
class Corpus:
    docs: DataFrame       # one row per distinct content
    versions: DataFrame   # doc_id, collection, tstamp, surt
    index: Index
    keys: DataFrame | None = None  # keys of field filters


def corpus_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version documents of the captured ``documents`` (one per distinct content)."""
    docs = version_docs(TB.document_captures(spark, sf_dir))
    return docs.withColumn("site", U.url_host("urlOldest"))


def corpus_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_versions(TB.document_captures(spark, sf_dir))


def write_corpus(spark: SparkSession, sf_dir: str, path: str, keys: bool = True) -> None:
    """Documents, versions and the index over them as Parquet tables; documents are tokenized
    once, statistics come from the stored tables. The index is written last. ``keys``: those of field filters too."""
    stored(corpus_versions(spark, sf_dir), "versions", f"{path}/versions")
    if keys:
        write_field_keys(named_captures(spark, sf_dir), f"{path}/keys")
    docs = stored(corpus_docs(spark, sf_dir), "docs", f"{path}/docs", **PACKED)
    build_index(docs, f"{path}/index")


def named_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TB.document_captures(spark, sf_dir).withColumn("warc_name", F.concat(F.lit("DOC-"), "collection", F.lit(".warc.gz")))


def read_corpus(spark: SparkSession, path: str) -> Corpus:
    read = spark.read.parquet
    keys = read(f"{path}/keys") if path_exists(spark, f"{path}/keys/_SUCCESS") else None
    return Corpus(read(f"{path}/docs"), read(f"{path}/versions"), Index.read(spark, f"{path}/index"), keys)


def corpus(spark: SparkSession, sf_dir: str, keys: bool = True) -> Corpus:
    """The stored corpus; written when this application asks for it first, the keys of field filters when they are asked for first."""
    key = hashlib.md5(f"{spark.sparkContext.applicationId} {sf_dir}".encode()).hexdigest()
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus/{key}"
    if not path_exists(spark, f"{path}/index/field_stats/_SUCCESS"):
        write_corpus(spark, sf_dir, path, keys)
    elif keys and not path_exists(spark, f"{path}/keys/_SUCCESS"):
        write_field_keys(named_captures(spark, sf_dir), f"{path}/keys")
    return read_corpus(spark, path)
