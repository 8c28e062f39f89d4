"""Every registered query of the engine equals its DuckDB oracle on the smallest tables."""
import datetime

import duckdb
import pytest

import __spark_entry__ as E
from archivesearch.plans.registry import REGISTRY

TABLES = ["pages", "documents", "events", "lineitem", "part", "benchmark"]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def _value(x):
    if isinstance(x, float):
        return f"{x:.9g}"
    return x.isoformat() if isinstance(x, (datetime.date, datetime.datetime)) else str(x)


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([_value(r[i]) for i in order]) for r in rows)


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "score" in df.columns


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_equals_oracle(spark, sf, duck, name):
    fn, sql = REGISTRY[name]
    got = fn(spark, sf)
    rows = _rows([tuple(r) for r in got.collect()], got.columns)
    if sql:
        want = duck.sql(sql)
        assert sorted(want.columns) == sorted(got.columns)
        assert rows == _rows(want.fetchall(), want.columns)
    else:
        assert rows


def test_oracles_are_subset():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", ["batch_search", "match_all", "version_docs", "anchor_text", "metadata_merge"])
def test_partitions_do_not_change_results(spark, sf, name):
    """The same result on 1 and on 40 shuffle partitions."""
    fn, _ = REGISTRY[name]
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (1, 40):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            df = fn(spark, sf)
            found.append(_rows([tuple(r) for r in df.collect()], df.columns))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]


def test_every_document_has_its_metadata(spark, tmp_path):
    """metadata_merge asks for each document at its own time, and finds it as text and as capture."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = [(i, f"title {i}\nbody", "en", f"src{i % 2}", 12) for i in range(15)]
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    event = [(1, datetime.datetime(2024, 1, 5), 3, "view", 1.0, "{}")]
    spark.createDataFrame(event, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(
        f"{tmp_path}/events.parquet")
    got = {r.req_id: r for r in REGISTRY["metadata_merge"][0](spark, str(tmp_path)).collect()}
    assert set(got) == {-2, *range(15)}
    assert all(got[i].found_text and got[i].found_cdx and got[i].title == f"title {i}" for i in range(15))
