"""Search requests: defaults, filters, field selection, odd values, edges."""
import pytest
from pyspark.sql import functions as F

from archivesearch.operators import captures as C
from archivesearch.operators import extract as X
from archivesearch.operators import filters as FL
from archivesearch.operators import links as L
from archivesearch.operators import search as S
from archivesearch.operators.index import URL_STOP_TERMS, field_tokens
from archivesearch.functions import urls as U
from archivesearch.plans.corpus import corpus
from archivesearch.plans.indexing import index_pages
from archivesearch.session import ensure_checkpoint_dir, stored

REQUEST = "qid long, q string, site array<string>, dedup_field string, fields array<string>, title_search string, max_items int, offset int"


@pytest.fixture(scope="module")
def store(spark, sf):
    return corpus(spark, sf)


def search(spark, store, rows, cfg=S.SearchConfig()):
    return S.page_search(spark.createDataFrame(rows, REQUEST), store.docs, store.versions, store.index, cfg)


def test_request_defaults(spark):
    rows = [(1, "a", ["x.org"], None, None, None, None, -3), (2, "a", None, None, None, None, -100, None),
            (3, "a", ["x.org"], "site", None, None, 5000, 2), (4, None, None, None, None, "t", None, None),
            (5, "http://www.example.org/a", None, None, None, None, None, None), (6, None, [], None, None, None, None, None)]
    got = {r.qid: r for r in S.normalize_queries(spark.createDataFrame(rows, REQUEST)).collect()}
    assert [got[i].dedup_field for i in (1, 2, 3)] == ["url", "title", "site"]
    assert (got[1].offset, got[1].max_items, got[2].max_items, got[3].max_items) == (0, 50, 0, 5000)
    assert [got[i].status for i in (4, 5, 6)] == ["ok", "rejected_url", "ok"] and got[6].site is None
    strict = S.normalize_queries(spark.createDataFrame(rows, REQUEST), S.SearchConfig(require_query=True))
    assert {r.qid for r in strict.filter("status = 'bad_request'").collect()} == {4, 6}


def test_mixed_batch(spark, store):
    n = store.docs.count()
    title = store.docs.agg(F.min("titleString")).first()[0]
    rows = [(1, None, None, None, None, None, 3, 0), (2, None, ["http://src1.example.org"], None, None, None, 1000, 0),
            (3, "the", None, None, ["TITLE"], None, 4, 0), (4, None, None, None, None, title, None, None),
            (5, "zzzz qqqq", None, None, None, None, None, None), (6, "http://www.example.org", None, None, None, None, None, None),
            (7, "the", None, None, None, None, 4, 100_000), (8, None, ["http://nowhere.net"], None, None, None, None, None)]
    res, summ = search(spark, store, rows)
    found = res.collect()
    by = {q: [r for r in found if r.qid == q] for q in range(1, 9)}
    s = {r.qid: r for r in summ.collect()}
    assert len(s) == 8 and s[6].status == "rejected_url" and not by[6]
    assert s[1].estimated_results == store.docs.select("titleString").distinct().count() <= n
    assert {r.rank for r in by[1]} == {1, 2, 3} and not s[1].last_page and s[1].next_offset == 3
    src1 = store.versions.filter(F.col("surt").startswith("(org,example,src1,")).select("doc_id").distinct().count()
    assert 0 < len(by[2]) <= src1 and s[2].last_page
    assert by[3] and all(r.title is not None and r.originalURL is None and r.snippet is None for r in by[3])
    assert by[4] and all(r.title == title and r.snippet is not None for r in by[4])
    assert not by[5] and s[5].estimated_results == 0
    assert not by[7] and s[7].last_page and s[7].previous_offset == 99_996
    assert not by[8]


def test_no_snippet_join_when_nobody_asks(spark, store):
    res, _ = search(spark, store, [(1, "the", None, None, ["title"], None, 4, 0)])
    assert "snippet" not in res.columns


def test_legacy_unknown_dedup_field_keeps_hits(spark, store):
    cfg = S.SearchConfig(off_value=0)
    _, known = search(spark, store, [(1, "the", None, "nosuchfield", None, None, 4, 0)], cfg)
    hits = store.index.postings.filter("term = 'the'").select("doc_id").distinct().count()
    assert known.first().estimated_results == hits > 0


def test_plan_of_a_batch_stays_small(spark, store):
    res, _ = search(spark, store, [(1, "the and", None, None, None, None, 4, 0)], S.SearchConfig(with_snippet=False))
    plan = res._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") < 20


def test_type_words(spark):
    docs = spark.createDataFrame([("a", "application/pdf"), ("b", "text/html"), ("c", "application/msword"), ("d", None),
                                  ("e", "pdf")], "id string, type string")
    asked = spark.createDataFrame([(1, ["PDF"]), (2, ["html", "word"]), (3, ["text/html"]), (4, ["nothing"])], "qid long, type array<string>")
    found = FL.type_hits(asked, docs)
    exact = (found.join(docs.withColumnRenamed("id", "doc_id"), "doc_id").join(asked.withColumnRenamed("type", "q"), "qid")
             .filter(FL.type_filter("type", "q")))
    want = {(q.qid, d.id) for q in asked.collect() for d in docs.collect()
            if spark.createDataFrame([(d.type, q.type)], "t string, q array<string>").select(F.coalesce(FL.type_filter("t", "q"), F.lit(False))).first()[0]}
    assert {(r.qid, r.doc_id) for r in exact.collect()} == want == {(1, "a"), (2, "b"), (2, "c"), (3, "b")}


def test_captures_with_impossible_dates_and_open_limits(spark):
    schema = "url string, timestamp string, digest string, `offset` string"
    caps = spark.createDataFrame([("http://a.org/", "20190231000000", "d1", "1"), ("http://a.org/", "20190401000000", "d2", "2"),
                                  ("http://a.org/", "20180101000000", "d3", "3")], schema)
    req = spark.createDataFrame([(1, "http://a.org", "20190302000000")], "req_id long, url string, tstamp string")
    best = C.closest_capture(req, caps).first()
    assert best.digest == "d1" and best.diff_seconds == 86400  # the 31st day from 1 February is 3 March
    rows = [(1, "http://a.org", None, None, None, None), (2, "http://a.org", "2019", "", 1, 1)]
    slices, totals = C.version_history(spark.createDataFrame(rows, "req_id long, url string, from string, to string, start int, limit int"), caps)
    assert sorted((r.req_id, r.pos) for r in slices.collect()) == [(1, 1), (1, 2), (1, 3), (2, 2)]
    assert {r.req_id: r.total for r in totals.collect()} == {1: 3, 2: 2}
    both = C.expand_url_requests(req)
    assert {r.url for r in both.collect()} == {"http://a.org", "https://a.org"}


def test_read_errors_are_errors(spark):
    recs = spark.createDataFrame([(None, None, None, None, "broken"), ("response", "http://a.org", "200", "text/html", None),
                                  ("response", "http://a.org", "302", "image/png", None)],
                                 "record_type string, url string, status string, content_type string, error string")
    assert {r.disposition: r.records for r in X.disposition_counts(recs).collect()} == {"error": 1, "accepted": 1, "discarded": 1}
    every = X.ExtractConfig(index_all=True, index_redirects=True)
    assert {r.disposition: r.records for r in X.disposition_counts(recs, every).collect()} == {"error": 1, "accepted": 2}


def _records(spark, rows):
    return spark.createDataFrame(rows, "url string, tstamp string, record_type string, status string, content_type string, "
                                       "payload binary, warc_name string, warc_offset long")


def test_charsets_and_own_parsers(spark):
    rows = [("http://a.org/1", "20200101000000", "response", "200", "text/html", b"<title>caf\xe9</title>", "w", 0),
            ("http://a.org/2", "20200101000000", "response", "200", "text/html; charset=windows-1252", b"<title>\x80uro</title>", "w", 1),
            ("http://a.org/3", "20200101000000", "response", "200", "text/html; charset=nonsense", "<title>é</title>".encode(), "w", 2),
            ("http://a.org/4", "20200101000000", "response", "200", "application/x-own", b"x y", "w", 3)]
    cfg = X.ExtractConfig(parsers={"application/x-own": lambda text: ("own", text.upper(), [("/z", "z")])})
    got = {r.url[-1]: r for r in X.build_page_data(_records(spark, rows), cfg).collect()}
    assert [got[i].title for i in "1234"] == ["café", "€uro", "é", "own"]
    assert got["4"].content == "X Y" and got["4"].out_links[0].to_url == "http://a.org/z"


def test_one_page_per_key_in_the_chain(spark):
    rows = [("http://a.org/1", t, "response", "200", "text/html", f"<title>{t}</title>".encode(), "w", n)
            for n, t in enumerate(["20200101000000", "20210101000000", "20210101000000"])]
    pages = _records(spark, rows)
    docs = index_pages(pages).collect()
    assert [(d.title, d.warc_offset) for d in docs] == [("20210101000000", 2)]
    assert index_pages(pages, policy="year").count() == 2 and index_pages(pages, keep="all").count() == 3


def test_all_links_of_a_page_count(spark):
    html = "".join(f'<a href="/{i}">l{i}</a>' for i in range(1500)).encode()
    page = X.build_page_data(_records(spark, [("http://a.org/", "20200101000000", "response", "200", "text/html", html, "w", 0)]))
    assert page.first().outlinks == 1500 and L.outlink_edges(page).count() == 1500


def test_merging_overlapping_crawls(spark):
    schema = "from_url string, to_url string, anchor string, tstamp string"
    a = L.invert_links(spark.createDataFrame([("http://x.org/1", "http://t.org/", "a", "20200101000000"), ("http://x.org/1", "http://t.org", "a", "20200102000000")], schema))
    b = L.invert_links(spark.createDataFrame([("http://x.org/1", "http://www.t.org/", "a", "20200103000000"), ("http://x.org/2", "http://t.org/", None, "20200103000000")], schema))
    assert a.count() == 1 and L.merge_edges(a, b).count() == 2


def test_legacy_filters(spark):
    row = spark.createDataFrame([("w.warc.gz", "http://a.org/x", "www.a.org", "http://a.org")], "warc string, url string, site string, s string")
    got = row.select(FL.arcname_filter("warc", F.lit("w.warc.gz")), FL.exact_url_filter("url", F.lit("http://a.org/x")),
                     FL.domain_filter("site", F.lit("a.org")), FL.domain_filter("site", F.lit("w.a.org")), FL.strip_scheme("s"),
                     *FL.legacy_bounds(F.lit(None).cast("string"), F.lit(None).cast("string"), now="20200101000000")).first()
    assert tuple(got) == (True, True, True, False, "a.org", "19960101000000", "20200101000000")


def test_url_stop_terms(spark):
    docs = spark.createDataFrame([("1", "t", "c", "http://www.example.org/index.html")], "id string, titleString string, content string, url string")
    fields = {"title": "titleString", "url": "url"}
    toks = {r.field: r.toks for r in field_tokens(docs, fields, URL_STOP_TERMS).collect()}
    assert toks == {"title": ["t"], "url": ["example"]}


def test_surt_join_equals_the_scalar(spark):
    urls = spark.createDataFrame([("http://www.a.org/x",), ("http://www.a.org/x",), (None,), ("",)], "u string")
    got = U.with_surt(urls, "u", "s").collect()
    assert sorted(r.s or "" for r in got) == sorted(r[0] or "" for r in urls.select(U.surt("u")).collect()) and len(got) == 4


def test_shared_folder_must_be_named_on_a_cluster(spark):
    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


def test_common_pairs_answer_phrases_alike(spark, store):
    """Equal results with pairs of common terms, whose own lists are not asked for."""
    from archivesearch.operators.index import build_index
    from archivesearch.session import shared_path
    docs = spark.createDataFrame([(str(i), "of the", t) for i, t in enumerate(
        ["to be or not to be", "the of the of the", "be the one of the few", "of of the the", "not the the of", "", None, "one of the few"])],
        "id string, titleString string, content string")
    plain = build_index(docs, shared_path(spark, "plain"))
    paired = build_index(docs, shared_path(spark, "paired"), {"title": "titleString", "content": "content"}, common_share=0.3)
    phrases = ["of the", "the of the", "of the few", "one of the few", "to be or not to be", "not the", "the the of", "of", "few of", "be the one of the"]
    aq = S.analyze_queries(S.normalize_queries(spark.createDataFrame([(i, f'"{p}"') for i, p in enumerate(phrases)], "qid long, q string")))
    for fields in (None, ("content",), ("title",)):
        want, got = (sorted(map(tuple, S.match_phrases(aq, x, fields).collect())) for x in (plain, paired))
        assert want == got and (want or fields == ("title",)), fields
    assert {r.term for r in paired.common.filter("field = 'content'").collect()} == {"of", "the"}
    words = spark.createDataFrame([("p", i, w) for i, w in enumerate("one of the few of x the".split())], "phrase string, place int, term string")
    asked = {(r.place, r.term) for r in S.phrase_terms(words, paired, ("content",)).collect()}
    assert asked == {(0, "one"), (1, "of the"), (3, "few"), (4, "of"), (5, "x"), (6, "the")}


def test_hits_of_a_batch_are_not_shuffled(spark, store, monkeypatch):
    """queries and postings meet behind the last exchange that is not by query, for plain and for large groups."""
    batch = spark.createDataFrame([(i, "the and of", "type" if i % 3 == 0 else "title" if i % 3 == 1 else "site", 3, -1 if i % 5 == 0 else 2)
                                   for i in range(1, 31)], "qid long, q string, dedup_field string, max_items int, dedup_value int")
    cfg = S.SearchConfig(operator="or", with_snippet=False)
    aq = S.analyze_queries(S.normalize_queries(batch, cfg))
    once = S.match_terms(aq, store.index, cfg)
    assert once._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[-1].count("Exchange hashpartitioning(qid") == 0

    def found():
        res, summ = S.page_search(batch, store.docs, store.versions, store.index, cfg)
        return (sorted((r.qid, r.rank, r.group_rank, r.doc_id, r.score) for r in res.collect()), sorted(map(str, summ.collect())))

    monkeypatch.setattr(S, "LARGE_GROUP", 1)
    split = found()
    monkeypatch.setattr(S, "LARGE_GROUP", 1 << 40)
    assert split == found() and split[0]
    hits = S.apply_filters(once, store.docs, store.versions, aq)
    keyed = hits.withColumn("group_key", S.group_key(hits)).collect()
    for qid in (1, 3, 5, 9):  # by brute force
        own = sorted(((-r.score, r.doc_id, r.group_key) for r in keyed if r.qid == qid and r.group_key is not None))
        heads = list(dict.fromkeys(k for *_, k in own))
        keep = 1 if qid == 5 else 2
        want = sorted((qid, n + 1, i + 1, d, -s) for n, k in enumerate(heads[:3]) for i, (s, d) in enumerate([(s, d) for s, d, g in own if g == k][:keep]))
        assert [r for r in split[0] if r[0] == qid] == want


def test_pairs_of_filters_are_not_shuffled(spark, store):
    """Documents are dealt out before they meet the filters of a batch, not the pairs after it."""
    rows = [(i, None, [f"http://src{i % 20}.example.org"], None, None, None, 5, 0) for i in range(40)]
    aq = S.analyze_queries(S.normalize_queries(spark.createDataFrame(rows, REQUEST)))
    aq = stored(aq.withColumn("collection", F.when(F.col("qid") % 2 == 0, F.array(F.lit("col1")))), "asked")
    for hits in (FL.site_hits(aq, store.versions), FL.collection_hits(aq, store.versions),
                 FL.time_hits(aq.withColumns({"lo": F.lit("20150101000000"), "hi": F.lit("20160101000000")}), store.docs)):
        plan = hits._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(qid#" not in plan.split("BroadcastExchange")[0]
    shape = S.batch_shape(aq.withColumns({"prefixes": F.lit(None).cast("array<string>"), "status": F.lit("ok")}))
    assert shape.filter_only and not shape.collection
    both = S.batch_shape(aq)
    assert both.collection and not both.site
