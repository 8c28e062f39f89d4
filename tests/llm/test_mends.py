"""Edges of the operators whose truth does not come from their code: edit budgets, short items, repetitive texts, noise, extra columns."""
import datetime
import random
import string
import tracemalloc

import pytest
from pyspark.sql import functions as F
from test_dedup_operators import distance

from archivesearch.llm import chat, decontaminate, hard_negatives, license_scan, line_dedup, packing, quality, simhash, token_store, toxicity, url_filter, warc
from archivesearch.llm.queries import TOKENIZER
from archivesearch.llm.shared import shared_path


def _words(rnd, n, low=2, high=8):
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(low, high))) for _ in range(n))


def _edited(rnd, text, edits):
    chars = list(text)
    for at in rnd.sample(range(1, len(chars) - 1), edits):
        chars[at] = rnd.choice(["", "z", chars[at] + "z"]) if chars[at] != " " else "z"
    return "".join(chars)


@pytest.mark.parametrize("size", [*range(24, 48), 64, 100, 333])
def test_edit_budget_is_a_tenth(size):
    """Within int(0.1 * m) edits an item is found, whatever its length; the truth is a plain edit distance."""
    rnd = random.Random(size)
    item = _words(rnd, 200)[:size].strip().ljust(size, "q")
    finder = decontaminate.Finder((item.encode(),))
    budget = int(0.1 * size)
    for edits in range(budget + 3):
        for _ in range(6):
            text = f"{_words(rnd, 5)} {_edited(rnd, item, edits)} {_words(rnd, 5)}"
            best = distance(item.encode(), decontaminate.normal_item(text))
            assert bool(finder.find([text])) == (best <= budget), (edits, best)


def test_short_items_match_as_whole_words():
    finder = decontaminate.Finder((b"short item", b"eight by", b"short item"))
    hits = finder.find(["A Short, item!", "a shorts item", "xshort item", "short itemx", "eight by", "Eight BY eight by", "short  item short item"])
    assert [(w, n) for w, n, *_ in hits] == [(0, 0), (0, 2), (4, 1), (5, 1), (5, 1), (6, 0), (6, 0), (6, 2), (6, 2)]


def test_items_under_the_bound_are_left_out(spark):
    docs = spark.createDataFrame([(1, "a tiny one"), (2, "quite short")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "tiny"), (2, "quite short"), (3, None), (4, " ")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()] == [(2, 2)]
    assert [r.doc_id for r in decontaminate.keep_clean(docs, bench).collect()] == [1]


@pytest.mark.parametrize("unit", ["a ", "ab "])
def test_repetitive_texts_in_bounded_memory(unit):
    item = (unit * 2000)[:1000].strip()
    finder = decontaminate.Finder((item.encode(),))
    text = unit * (1_000_000 // len(unit))
    tracemalloc.start()
    hits = finder.find([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert hits and {n for _, n, *_ in hits} == {0} and peak < 500_000_000
    assert len(hits) >= 900  # one after the other


def test_long_regions_are_searched_in_stretches():
    """Many edited copies one after the other: each is found, none twice."""
    rnd = random.Random(3)
    item = _words(rnd, 18)
    copies = [_edited(rnd, item, 4) for _ in range(200)]
    hits = decontaminate.Finder((item.encode(),)).find([" ".join(copies)])
    assert len(hits) == 200 and all(b[2] >= a[3] for a, b in zip(hits, hits[1:]))


# ---------------------------------------------------------------- quality

def _prose(rnd, words, n):
    return " ".join(rnd.choice(words) + rnd.choice(["", "", "", ",", "."]) for _ in range(n))


def test_fitted_limits_reject_noise_and_keep_prose(spark):
    """Letters and hex from 4 KB on, digits from 16 KB on; prose of its own vocabulary stays."""
    rnd = random.Random(9)
    words = ["".join(rnd.choice("aeinorstldcu") for _ in range(rnd.randint(2, 9))) for _ in range(900)]
    rows = [(i, _prose(rnd, words, rnd.choice([700, 1000, 1500, 3500, 5000]))) for i in range(900)]
    noise = [(letters, size) for letters in (string.ascii_lowercase, "0123456789abcdef") for size in (5000, 9000, 20_000, 30_000)]
    noise += [(string.ascii_letters + string.digits + "+/", 3000)]
    bad = [(1000 + i, " ".join("".join(rnd.choices(al, k=rnd.randint(4, 60))) for _ in range(size // 30))) for i, (al, size) in enumerate(noise)]
    out = quality.quality(spark.createDataFrame(rows + bad, "doc_id long, text string").repartition(4))
    kept = {r.doc_id for r in out.filter("kept").select("doc_id").collect()}
    assert not kept & {i for i, _ in bad}
    assert len(kept) >= 0.98 * len(rows)


def test_the_last_chunk_is_judged():
    limits = quality.Limits()
    import zstandard
    compress = zstandard.ZstdCompressor(level=3).compress
    rnd = random.Random(1)
    text = _prose(rnd, ["plain", "words", "of", "some", "text", "here", "and", "there"] + [_words(rnd, 1) for _ in range(300)], 3000)[:4096 * 3]
    tail = "".join(rnd.choices(string.ascii_letters + string.digits + "+/", k=4000))
    *_, chunks, bad, _ = quality.measure(text + tail, compress, limits)
    assert (chunks, bad) == (4, 1)
    *_, chunks, bad, _ = quality.measure(tail, compress, limits)
    assert chunks == 1 and quality.measure(tail, compress, limits)[-1] == "incompressible"
    few = quality.fit_limits  # small tables keep the fixed bands
    assert callable(few) and limits.upper == {} and limits.band(5000) == quality.band_of(5000)


def test_length_classes():
    for size in range(1, 70_000, 37):
        assert 2 ** (quality.length_class(size) / 2) <= size * (1 + 1e-9) < 2 ** ((quality.length_class(size) + 1) / 2) * (1 + 1e-9)


# ---------------------------------------------------------------- columns named like the operators' own

CLASH = ["_id", "_gone", "_quality", "_toxicity", "_capture", "capture", "b", "best", "n", "h", "key", "fp", "component", "vertex", "line", "owner",
         "ids", "score", "number", "block", "part", "size", "verdict"]


def _with_clashes(df):
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASH if c not in df.columns})


def _carried(out, lost=()):
    for c in CLASH:
        if c in out.columns and c not in lost:
            assert {r[0] for r in out.select(f"`{c}`").distinct().collect()} <= {f"own {c}"}, c


def test_extra_columns_do_no_harm(spark):
    rnd = random.Random(5)
    rows = [(i, _words(rnd, 40) + "\n" + "a line that stands in very many of the documents here\n") for i in range(12)] + [(12, None), (None, "x")]
    docs = _with_clashes(spark.createDataFrame(rows, "doc_id long, text string"))
    labels = _with_clashes(spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, toxic int"))
    bench = _with_clashes(spark.createDataFrame([(1, _words(rnd, 20))], "item_id long, text string"))
    _carried(line_dedup.dedup_lines(docs), ("line", "key"))
    assert decontaminate.find_leaks(docs, bench).count() == 0
    clean = decontaminate.keep_clean(docs, bench)
    assert clean.columns == docs.columns and clean.count() == 14
    path = shared_path(spark, "store")
    token_store.write_store(docs, path, TOKENIZER)
    assert token_store.digest(spark, path).count() == 14
    _carried(license_scan.license_scan(docs), ("score", "labels"))
    assert simhash.keep_one(docs).columns == docs.columns and simhash.keep_one(docs).count() >= 12
    _carried(quality.quality(docs), ("verdict",))
    assert quality.keep_good(docs).columns == docs.columns
    assert packing.digest(packing.bucketed(docs, TOKENIZER)).count() >= 14
    _carried(toxicity.score(docs, toxicity.train(docs, labels)), ("score",))
    pages = _with_clashes(docs.select(F.col("doc_id").alias("page_id"), F.lit("http://a.org/x").alias("url"), F.col("text").alias("html")))
    path = shared_path(spark, "archives")
    warc.write_archives(pages, path)
    assert warc.digest(warc.assemble(warc.read_archives(spark, path))).count() == 14
    captures = _with_clashes(pages.select("page_id", "url").withColumn("fetched", F.lit(datetime.date(2020, 5, 1))))
    entries = spark.createDataFrame([("l", "block", "domain", "A.org.", "add", datetime.date(2019, 1, 1)), ("m", "block", "prefix", "a.ORG/x/", "add", datetime.date(2020, 1, 1))],
                                    "list_name string, action string, kind string, value string, event string, day date")
    out = url_filter.filter_urls(captures, _with_clashes(entries))
    assert {(r.matched_kind, r.matched_value, r["verdict"]) for r in out.collect()} == {("prefix", "a.org/x", "block")}
    _carried(out, ("verdict",))
    turns = _with_clashes(docs.select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), "text"))
    assert chat.digest(turns, TOKENIZER).count() == 14
    vectors = _with_clashes(spark.createDataFrame([(100 + i, [0.1 * i, 1.0], i % 2) for i in range(9)], "vec_id long, embedding array<double>, label int"))
    from archivesearch.llm import vector_codes
    codes, book = vector_codes.fit(vectors)
    assert vector_codes.digest(codes, book).count() == 9
    assert hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0).count() >= 0


def test_intervals_hold_over_years(spark):
    day = datetime.date
    entries = spark.createDataFrame([("l", "block", "host", "a.org", "add", day(2017, 3, 1)), ("l", "block", "host", "a.org", "remove", day(2021, 2, 1)),
                                     ("l", "block", "host", "a.org", "add", day(2023, 1, 1))],
                                    "list_name string, action string, kind string, value string, event string, day date")
    days = [day(2017, 2, 28), day(2017, 3, 1), day(2018, 1, 1), day(2019, 12, 31), day(2020, 6, 1), day(2021, 1, 31), day(2021, 2, 1), day(2022, 7, 1), day(2023, 1, 1), day(2025, 1, 1)]
    captures = spark.createDataFrame([(i, "http://a.org/", d) for i, d in enumerate(days)], "page_id long, url string, fetched date")
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(captures, entries).collect()}
    assert [got[i] for i in range(len(days))] == ["allow", *["block"] * 5, "allow", "allow", "block", "block"]
