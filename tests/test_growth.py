"""What grows with the input: plans that hold, shuffle or store no more than they need, with equal rows."""
import random
import tempfile
from dataclasses import replace

from pyspark.sql import functions as F

from archivesearch.functions import urls as U
from archivesearch.operators import fields as FD
from archivesearch.operators import index as I
from archivesearch.operators import links as L
from archivesearch.operators import search as S
from archivesearch.operators.docs import latest_per_key
from archivesearch.operators.index import add_pairs, build_index
from archivesearch.plans import corpus as CP

REQUEST = "qid long, q string, dedup_field string, type array<string>"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plain_urls_are_taken_apart_by_one_pattern(spark):
    plain = ["http://www.a.pt/p/1/", "https://a.b-c.pt", "http://www12.x.pt/a.html", "http://a.pt/~u/(x);y,z", "http://1.2.pt/", "http://a.pt/x..y"]
    odd = ["", None, "a.pt/x", "HTTP://A.pt/", "http://a.pt:80/", "http://u@a.pt/", "http://a.pt/../x", "http://a.pt/./", "http://a.pt//", "http://a.pt/x//", "http://www.com/",
           "http://www.pt", "http://1.2.3.4/x", "http://www.1.2.3.4/", "http://a.pt/?q", "http://a.pt/x#f", "<http://a.pt/>", "http://a.pt/x\n", "http://a.pt/x/\n", "http://.pt/",
           "http://a..pt/", "http://a.pt./", "ftp://a.pt/x", "http://a.pt/é", "http://a.pt/.x", "http://a.pt/" + "x/" * 20_000, "http://a.pt/" + "y" * 20_000]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(plain + odd)], "i int, url string")
    got = U.with_surt(rows, "url", "fast").withColumn("slow", U.surt("url")).collect()
    assert [r.url for r in got if r.fast != r.slow] == [] and [r.fast is None for r in got] == [r.slow is None for r in got]
    taken = rows.filter(F.col("url").rlike(U._PLAIN_RE)).collect()
    assert {r.url for r in taken if r.i < len(plain)} == set(plain) and len([r for r in taken if r.i >= len(plain)]) == 2


def test_latest_page_and_its_count_in_one_aggregate(spark):
    rows = [("(pt,a,)", f"201{i % 3}0101000000", f"w{i % 2}", i % 4, f"t{i % 4}") for i in range(12)] + [(None, "20100101000000", "w", 1, "n"), ("(pt,b,)", None, None, None, "m")]
    pages = spark.createDataFrame(rows, "surt_url string, tstamp string, warc_name string, warc_offset long, title string")
    bare = pages.drop("title")
    for policy in ("none", "year"):
        whole = latest_per_key(pages, policy)
        want = sorted(map(str, whole.drop("title").collect()))
        one = latest_per_key(bare, policy)
        assert "Join" not in plan(one) and sorted(map(str, one.select(whole.drop("title").columns).collect())) == want
        for p in (pages, bare):
            counted = latest_per_key(p, policy, captures="captures")
            assert counted.columns == [*p.columns, "surt", "time_slice", "captures"]
            assert sorted(map(str, counted.select(whole.drop("title").columns).collect())) == want
            assert counted.agg(F.sum("captures")).first()[0] == len(rows)


def test_inlinks_are_summed_up_in_one_pass(spark):
    rows = [("(pt,a,)", "", f"http://h{i % 3}.pt/{i}", ("", "b", "a")[i % 3 if i % 2 else 0]) for i in range(40)] + [("(pt,b,)", "", "http://h.pt/", ""), ("(pt,c,)", "", "no host", "x")]
    inlinks = spark.createDataFrame(rows, "surt string, time_slice string, from_url string, anchor string")
    out = L.inlink_summary(inlinks)
    assert "Join" not in plan(out)
    want = L.inlink_counts(inlinks).join(L.anchor_text(inlinks).drop("anchor_count"), L.EDGE_KEY, "left").select(*L.EDGE_KEY, F.coalesce("anchor", F.lit("")), "inlinks")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


def test_versions_meet_field_filters_in_their_rows(spark):
    captures = spark.createDataFrame(
        [(f"d{i % 30}", f"col{i % 3}", f"20{10 + i % 5}0101000000", f"(pt,a{i},)", f"http://a{i % 4}.b.pt/{i}", f"col{i % 3}.warc.gz", ("pt", "en")[i % 2]) for i in range(60)],
        "digest string, collection string, tstamp string, surt string, url string, warc_name string, lang string")
    keys = FD.field_keys(captures)
    rows = [(1, ["col1.warc.gz", "col2.warc.gz", None], None, None), (2, ["col0.warc.gz"], ["b.pt", "a1.b.pt"], None), (3, None, ["a1.b.pt", "pt", "b.pt"], ["PT"]),
            (4, [None], ["pt"], None), (5, None, ["nowhere"], ["pt"]), (6, ["col0.warc.gz"], ["a2.b.pt"], ["pt", "en"])]
    aq = spark.createDataFrame(rows, "qid long, arcname array<string>, domain array<string>, lang array<string>").withColumn("n_fields", FD.asked_fields(
        spark.createDataFrame(rows, "qid long, arcname array<string>, domain array<string>, lang array<string>")))
    out = FD.matching_versions(aq, keys)
    assert "keys=[qid" not in plan(out) and "hashpartitioning(qid" not in plan(out)
    got, want = sorted((r.qid, r.doc_id, r.version) for r in out.collect()), set()
    for c in captures.withColumn("v", FD.version_key()).collect():
        host = c.url.split("/")[2]
        for qid, arc, domain, lang in rows:
            if ((arc is None or c.warc_name in arc) and (domain is None or any(x and (host == x or host.endswith("." + x)) for x in domain))
                    and (lang is None or c.lang in [x.lower() for x in lang])):
                want.add((qid, c.digest, c.v))
    assert got == sorted(want) and {q for q, *_ in got} == {1, 2, 3, 6}


def test_searches_shuffle_documents_without_their_texts(spark, sf):
    c = CP.corpus(spark, sf)
    aq = S.analyze_queries(S.normalize_queries(spark.createDataFrame([(1, "the of", "title", None), (2, "and", "type", None)], REQUEST)))
    shape = S.batch_shape(aq)
    by_group = plan(S.search_groups(aq, c.docs, c.index, shape, S.SearchConfig(operator="or")))
    assert "collect_list" in by_group and "d_titleString" not in by_group
    limited = S.analyze_queries(S.normalize_queries(spark.createDataFrame([(1, "the of", "type", ["html"])], REQUEST)))
    assert "d_type" in plan(S.search_groups(limited, c.docs, c.index, S.batch_shape(limited), S.SearchConfig(operator="or")))
    dealt = [x for x in plan(S.match_terms(aq, c.index, S.SearchConfig(operator="or"))).splitlines() if "REPARTITION_BY_NUM" in x]
    assert dealt and not any("term#" in x for x in dealt)


def test_a_corpus_holds_keys_of_fields_when_they_are_asked_for(spark, sf, monkeypatch):
    path = tempfile.mkdtemp(prefix="run-")
    monkeypatch.setattr(CP, "ensure_checkpoint_dir", lambda spark: path)
    assert CP.corpus(spark, sf, keys=False).keys is None
    later = CP.corpus(spark, sf)
    rows = FD.field_keys(CP.named_captures(spark, sf))
    assert later.keys.exceptAll(rows).isEmpty() and rows.exceptAll(later.keys).isEmpty()
    assert CP.corpus(spark, sf, keys=False).keys is not None


def test_pairs_are_added_to_an_index(spark):
    docs = spark.createDataFrame([("a", "x y x", "y x y x y"), ("b", "", "x y z x y"), ("c", None, "z"), ("b", "y x", "x x")], "id string, titleString string, content string")
    path = tempfile.mkdtemp(prefix="run-")
    whole = build_index(docs, f"{path}/whole", common_share=0.1)
    added = add_pairs(docs, build_index(docs, f"{path}/plain"), f"{path}/pairs", 0.1)
    assert sorted(map(str, whole.pairs.collect())) == sorted(map(str, added.pairs.collect())) and whole.common.exceptAll(added.common).isEmpty()
    got = {(r.term, r.field, r.doc_id): r.positions for r in added.pairs.collect()}
    assert got["y x", "content", "a"] == [0, 2] and got["x y", "title", "a"] == [0]


def test_equal_requests_are_searched_once(spark, sf):
    c = CP.corpus(spark, sf)
    titles = [r[0] for r in c.docs.groupBy("titleString").count().orderBy(F.desc("count"), "titleString").limit(2).select("titleString").collect()]
    rows = [(i, None, titles[i % 2], -1, 3 + (i > 8)) for i in range(12)] + [(20, "the", None, 2, 3), (21, "the", None, 2, 3), (22, "of", None, 2, 3), (None, "the", None, 2, 3)]
    rows += [(30, None, titles[0], -1, 3)] * 2 + [(31, None, titles[1], -1, 3), (31, "the", None, -1, 3)] + [(32, "the", None, 2, 3)] * 2 + [(40, "http://a.pt/", None, 2, 3)]
    batch = spark.createDataFrame(rows, "qid long, q string, title_search string, dedup_value int, max_items int")
    aq = S.analyze_queries(S.normalize_queries(batch))
    asked, turns = S.distinct_requests(aq)
    assert sorted((r.qid, r.asked, r.copies) for r in turns.collect()) == sorted(
        [(i, i % 2 if i <= 8 else 9 + (i - 9) % 2, 1) for i in range(12)] + [(20, 20, 1), (21, 20, 1), (22, 22, 1), (30, 0, 2), (31, 31, 1), (32, 32, 1)])
    assert sorted(r.qid for r in asked.collect()) == [0, 1, 9, 10, 20, 22, 31, 31, 32, 32]
    assert S.distinct_requests(aq.filter("qid in (0, 1, 22)"))[1] is None

    cfg = S.SearchConfig(operator="or", with_snippet=False)
    res, summ = S.page_search(batch, c.docs, c.versions, c.index, cfg)
    cols = ["rank", "group_rank", "doc_id", "score"]
    got, counts = {}, {}
    for r in res.collect():
        got.setdefault(r.qid, []).append(tuple(r[x] for x in cols))
    for r in summ.collect():
        counts.setdefault(r.qid, []).append((r.estimated_results, r.number_results, r.status))
    for qid in (0, 1, 9, 10, 20, 21, 22):  # as when each is alone in its batch
        alone, total = S.page_search(batch.filter(F.col("qid") == qid), c.docs, c.versions, c.index, cfg)
        assert sorted(got[qid]) == sorted(tuple(r[x] for x in cols) for r in alone.collect()) and got[qid]
        assert counts[qid] == [(r.estimated_results, r.number_results, r.status) for r in total.collect()]
    assert all(sorted(got[i]) == sorted(got[i % 2]) for i in range(9)) and sorted(got[30]) == sorted(got[0] * 2) and len(counts[30]) == 2
    assert None not in got and counts[None][0][0] == 0 and counts[40][0][2] == "rejected_url"


def test_conjunctions_of_many_terms_count_each_once(spark):
    words = [f"w{i}" for i in range(600)]
    docs = spark.createDataFrame([("all", "w0 w1 w599", " ".join(words)), ("title", "w0 w1", "w0"), ("most", "w599", " ".join(words[:599])), ("less", "w0", " ".join(words[:70]))],
                                 "id string, titleString string, content string")
    index = build_index(docs, f"{tempfile.mkdtemp(prefix='run-')}/index")
    batch = spark.createDataFrame([(1, "w0 w1"), (2, " ".join(words[:70])), (3, " ".join(words[:600])), (4, "w0 w0 w599"), (5, "w2 -w599")], "qid long, q string")
    for some in ("qid <> 3", "qid > 0"):  # bits, and more terms than bits are kept for
        aq = S.analyze_queries(S.normalize_queries(batch.filter(some)))
        got = sorted((r.qid, r.doc_id) for r in S.match_terms(aq, index).select("qid", "doc_id").collect())
        want = [(1, "all"), (1, "less"), (1, "most"), (1, "title"), (2, "all"), (2, "less"), (2, "most"), (3, "all"), (3, "most"), (4, "all"), (4, "most"), (5, "less")]
        assert got == [w for w in want if some == "qid > 0" or w[0] != 3]
        assert ("Expand" in plan(S.match_terms(aq, index))) is False


def test_postings_are_dealt_out_in_lists_of_documents(spark, sf):
    c = CP.corpus(spark, sf)
    aq = S.analyze_queries(S.normalize_queries(spark.createDataFrame([(1, "the of", None, None), (2, '"of the"', None, None)], REQUEST)))
    for operator in ("and", "or"):
        p = plan(S.match_terms(aq, c.index, S.SearchConfig(operator=operator)))
        assert "a_no#" in p and "count(distinct" not in p
    by_group = plan(S.search_groups(aq.filter("size(terms) > 0"), c.docs, c.index, S.batch_shape(aq), S.SearchConfig(operator="or")))
    assert "partial_collect_list(no" in by_group and "partial_collect_list(struct" not in by_group
    phrases = plan(S.match_phrases(aq.filter("size(phrases) > 0"), c.index))
    assert "partial_collect_list(pos" in phrases and "REPARTITION_BY_COL" not in phrases
    assert not [x for x in phrases.splitlines() if "hashpartitioning(" in x and "doc_id" in x and "hashpartitioning(doc_id" not in x]  # what is found stays with its document


def test_phrases_do_not_reach_from_field_to_field(spark):
    docs = spark.createDataFrame([("a", "x y", "z x y z"), ("b", "z", "x"), ("c", None, "y z"), ("d", "x y z", None)], "id string, titleString string, content string")
    index = build_index(docs, f"{tempfile.mkdtemp(prefix='run-')}/index")
    batch = spark.createDataFrame([(1, '"x y"'), (2, '"y z"'), (3, '"x y z"'), (4, '"z x"'), (5, '"x y" "y z"'), (6, '"y"'), (7, '"x nowhere"')], "qid long, q string")
    aq = S.analyze_queries(S.normalize_queries(batch))
    want = [(1, "a"), (1, "d"), (2, "a"), (2, "c"), (2, "d"), (3, "a"), (3, "d"), (4, "a"), (5, "a"), (5, "d"), (6, "a"), (6, "c"), (6, "d")]
    assert sorted(map(tuple, S.match_phrases(aq, index).collect())) == want
    assert sorted(map(tuple, S.match_phrases(aq, index, ("title",)).collect())) == [(1, "a"), (1, "d"), (2, "d"), (3, "d"), (5, "d"), (6, "a"), (6, "d")]
    scored = S.match_terms(aq, index, within=S.match_phrases(aq, index))
    assert sorted((r.qid, r.doc_id) for r in scored.collect()) == want and all(r.score > 0 for r in scored.collect())


def test_stored_tables_leave_no_shuffle_files(spark):
    from archivesearch.session import CLEANUP, PACKED, stored
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def shuffled():
        return sum(f.getName().startswith("shuffle_") for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(disk.getAllFiles()))

    before = shuffled()
    rows = stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "t", **PACKED)
    assert shuffled() <= before and rows.count() == 7
    assert spark.conf.get(CLEANUP, None) in (None, "false")
    assert any(f.endswith(".zstd.parquet") for f in rows.inputFiles())


def test_only_texts_of_the_page_are_shuffled(spark, sf):
    """The texts meet the keys of the stored page before any exchange."""
    c = CP.corpus(spark, sf)
    queries = spark.createDataFrame([(1, "the of", "title", None)], REQUEST).withColumn("max_items", F.lit(2))
    for strategy in ("first", "best"):
        res, _ = S.page_search(queries, c.docs, c.versions, c.index, S.SearchConfig(operator="or", snippet_strategy=strategy))
        lines, reads = plan(res.select("qid", "doc_id", "snippet")).splitlines(), 0
        for i, line in enumerate(lines):
            if "FileScan" in line and "content#" in line:
                above = next(x for x in reversed(lines[:i]) if "Join" in x or "Exchange" in x)
                reads += 1
                assert "LeftSemi" in above
        assert reads and all(r.snippet for r in res.collect())


def test_hits_are_not_shuffled_whatever_the_files_of_the_batch_take_up(spark, sf):
    """A threshold that no file of the batch's tables keeps: postings and hits still meet them as broadcasts; rows are the same without."""
    c = CP.corpus(spark, sf)
    rows = [(1, "the of", "title", None), (2, "and the", "type", None), (3, "of -the", "collection", None), (4, '"of the"', "title", None)]
    batch = spark.createDataFrame(rows, REQUEST)
    aq = S.analyze_queries(S.normalize_queries(batch))
    plain, phrased = aq.filter("size(terms) > 0"), aq.filter("size(phrases) > 0")

    def searches():
        return [S.match_terms(plain, c.index), S.search_groups(plain, c.docs, c.index, S.batch_shape(plain), S.SearchConfig(operator="or")),
                S.match_terms(phrased, c.index, within=S.match_phrases(phrased, c.index))]

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    wide = [sorted(map(str, df.collect())) for df in searches()]
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1b")
        tight = searches()
        assert [sorted(map(str, df.collect())) for df in tight] == wide and all(wide)
        for df in tight[:2]:
            joins = [x for x in plan(df).splitlines() if "SortMergeJoin" in x or "ShuffledHashJoin" in x]
            assert not [x for x in joins if "[no#" in x or "[term#" in x or "[qid#" in x], joins
        res, _ = S.page_search(batch.filter("qid <= 2"), c.docs, c.versions, c.index, S.SearchConfig(operator="or"))
        texts = plan(res.select("qid", "snippet")).splitlines()
        for i, line in enumerate(texts):
            if "FileScan" in line and "content#" in line:
                assert "LeftSemi" in next(x for x in reversed(texts[:i]) if "Join" in x or "Exchange" in x)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_tasks_hold_few_hits_and_short_keys(spark):
    """The hits of a task are bounded by what its memory sums up without spilling; long titles are not carried by hits, equal ones still collapse."""
    long, other = "t" * 5_000, "t" * 5_000 + "u"
    docs = spark.createDataFrame([(f"d{i}", (long, other, "t", None)[i % 4], "x y", "text", "c0", "h", f"(pt,d{i},)", "20100101000000", "20100101000000") for i in range(12)],
                                 "id string, titleString string, content string, type string, collection string, site string, surtOldest string, tstampOldest string, tstampLatest string")
    index = build_index(docs, f"{tempfile.mkdtemp(prefix='run-')}/index")
    aq = S.analyze_queries(S.normalize_queries(spark.createDataFrame([(1, "x y", "title", None)], REQUEST)))
    assert S._tasks(S._batch_terms(aq, index, S.SearchConfig()), replace(index, term_stats=index.term_stats.withColumn("df", F.lit(50_000_000)))) >= 100
    found = S.search_groups(aq, docs, index, S.batch_shape(aq), S.SearchConfig(operator="or"))
    got = {}
    for r in found.collect():
        got.setdefault(r.head_doc or r.doc_id, []).append(r.doc_id)
    assert sorted(map(sorted, got.values())) == [["d0", "d4"], ["d1", "d5"], ["d10", "d2"]]
    keys = spark.createDataFrame([(long,), (other,), ("t",), ("t" * 45,), (None,)], "k string").select(S.short_key(F.col("k")).alias("s")).collect()
    assert len({r.s for r in keys}) == 5 and max(len(r.s or "") for r in keys) == 45


def _phrase_case(spark, share):
    """An index of random words, the phrases of a batch, and what they meet by hand."""
    rng = random.Random(4)
    words = ["a", "b", "c", "ab", "été", "z9"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(f"d{i}", text(rng.randrange(4)), text(rng.choice((0, 1, 2, 30)))) for i in range(40)] + [("none", None, None)]
    asked = [(i, text(rng.randrange(1, 5))) for i in range(60)]
    want = sorted((q, d) for q, p in asked for d, *fields in docs if any(f" {p} " in f" {f} " for f in fields if f))
    index = build_index(spark.createDataFrame(docs, "id string, titleString string, content string").repartition(3), f"{tempfile.mkdtemp(prefix='run-')}/index", common_share=share)
    return index, S.analyze_queries(S.normalize_queries(spark.createDataFrame([(q, f'"{p}"') for q, p in asked], "qid long, q string"))), want


def test_places_of_phrases_are_sorted_as_numbers(spark):
    """Words of a document and their places are long integers: an interpreted comparison of structures took most of the time of phrases."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    for share, enabled in ((None, "true"), (0.3, "false")):
        spark.conf.set("spark.sql.adaptive.enabled", enabled)  # without it, the numbers of words come from several parts
        try:
            index, aq, want = _phrase_case(spark, share)
            assert sorted(map(tuple, S.match_phrases(aq, index).collect())) == want
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        assert share or "lambdafunction" not in plan(S.match_phrases(aq.filter("size(phrases[0]) = 2"), index))


def test_an_index_is_sorted_without_interpreted_comparisons(spark, monkeypatch):
    written = {}
    write = I.write_table
    monkeypatch.setattr(I, "write_table", lambda df, path, **options: (written.update({path.rsplit("/", 1)[1]: plan(df)}), write(df, path, **options)))
    index, _, _ = _phrase_case(spark, 0.3)
    assert "array_sort(" not in written["postings"] + written["pairs"] and "collect_list(struct" not in written["pairs"]
    rows = index.postings.filter("term is not null").collect()
    assert all(r.tf == len(r.positions) and r.positions == sorted(set(r.positions)) for r in rows)
    held = {}
    for r in rows:
        held.setdefault((r.doc_id, r.field, r.field_len), []).extend(r.positions)
    assert all(sorted(p) == list(range(n)) for (_, _, n), p in held.items())
    assert {(r.tf, tuple(r.positions), r.field_len) for r in index.postings.filter("term is null").collect()} == {(0, (), 0)}
    assert index.postings.filter("doc_id = 'none'").count() == 2
