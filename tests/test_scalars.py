"""Golden values of the URL, time, id and query-model scalars (FIXTURES.md §2)."""
import pytest
from pyspark.sql import functions as F

from archivesearch.functions import hashes as H
from archivesearch.functions import present as PR
from archivesearch.functions import text as T
from archivesearch.functions import timestamps as TS
from archivesearch.functions import urls as U
from archivesearch.operators import search as S


def one(spark, col, value, typ="string"):
    return spark.createDataFrame([(value,)], f"x {typ}").select(col.alias("r")).first()["r"]


def test_canonical_and_surt(spark):
    assert one(spark, U.canonical_url(F.col("x")), "http://publico.pt") == "http://publico.pt/"
    assert one(spark, U.surt(F.col("x")), "http://publico.pt/") == "(pt,publico,"
    assert one(spark, U.surt(F.col("x")), "http://www.example.com/p/5/") == "(com,example,)/p/5"
    assert one(spark, U.canonical_url(F.col("x")), "HTTP://WWW.Example.COM:80/a/./b/../c") == "http://www.example.com/a/c"
    assert one(spark, U.surt_to_url(F.col("x")), "(pt,publico,") == "https://publico.pt/"
    assert one(spark, U.canonical_url(F.col("x")), "") is None


def test_page_id_golden(spark):
    df = spark.createDataFrame([("19961013180344", "http://publico.pt/")], "t string, u string")
    assert df.select(H.page_id("t", "u")).first()[0] == "19961013180344/FhcAj9+g5IrKjL+HJyyf3g=="


@pytest.mark.parametrize("text,expected", [
    ("https://example.com/path1/path2?parameter1=something&parameter2=something", True),
    ("example.com/path1/path2?parameter1=something&parameter2=something", True),
    ("http://example.com?url=http://archive.example.pt", True),
    ("http://naturalmenteistonaoeumurl/path1", False),
    ("term1 term2", False),
])
def test_url_validator(spark, text, expected):
    assert one(spark, U.is_url(F.col("x")), text) is expected


def test_time_slices():
    assert [TS.slice_length(p) for p in ("none", "year", "monthly", "daily")] == [0, 4, 6, 8]
    with pytest.raises(ValueError):
        TS.slice_length("nosense")


def test_bounds_and_canonical_timestamp(spark):
    assert one(spark, TS.bound_padding(F.col("x")), "201901010101010101") == "20190101010101"
    assert one(spark, TS.bound_padding(F.col("x")), "202001010101") == "20200101010100"
    assert one(spark, TS.canonical_timestamp(F.col("x")), "abc") == "19910101000000"
    assert one(spark, TS.canonical_timestamp(F.col("x")), "19801399256161") == "19910101000000"
    assert one(spark, TS.canonical_timestamp(F.col("x")), "20190231") == "20190231000000"


def test_query_model(spark):
    q = spark.createDataFrame([(1, "x", 10, -100), (2, "x", 10, 50), (3, "http://a.pt", None, None)],
                              "qid long, q string, offset int, max_items int")
    rows = {r.qid: r for r in S.normalize_queries(q).collect()}
    assert rows[1].max_items == 0 and rows[2].max_items == 50 and rows[3].status == "rejected_url"


def test_query_analysis(spark):
    q = spark.createDataFrame([('"new york" pizza -pineapple "open', )], "q string")
    r = q.select(T.query_phrases("q").alias("p"), T.query_terms("q").alias("t"),
                 T.query_excludes("q").alias("e")).first()
    assert r.p == [["new", "york"]] and r.e == ["pineapple"] and r.t == ["pizza", "open"]


def test_links_golden(spark):
    df = spark.createDataFrame([("http://sapo.ua.pt/", "19961013150238")], "u string, t string")
    links = df.select(*[c.alias(n) for n, c in PR.link_columns("u", "t").items()]).first()
    assert links.linkToMetadata.endswith("?metadata=http%3A%2F%2Fsapo.ua.pt%2F%2F19961013150238")
    assert links.linkToOriginalFile.endswith("/19961013150238id_/http://sapo.ua.pt/")
    assert one(spark, H.result_id(F.lit("2019"), F.col("x")), "http://example.com") == "2019/http://example.com"
