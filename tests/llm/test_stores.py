"""Token store, packing, WARC transactions, URL lists and the pipeline: round trips and odd inputs."""
import datetime
import gzip
import hashlib
import random
import tempfile
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from archivesearch.llm import packing, token_store, tokenizing, url_filter, warc
from archivesearch.llm.queries import ORACLES, QUERIES, TOKENIZER

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", " ", "Hello world, it's   me\n\n\tok", "日本語 ½ é", "a<|endoftext|>b", "x" * 9000, "same words again " * 3000,
         "\x1c\x1f\x85\xa0 mixed 12ab 'S's"]


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(1)
    more = [" ".join(rnd.choice(["the", "of", "Ration", "42", "é"]) + rnd.choice([",", "", "\n"]) for _ in range(rnd.randint(1, 200)))
            for _ in range(60)]
    rows = [(i, t, 5) for i, t in enumerate(TEXTS)] + [(100 + i, t, 6) for i, t in enumerate(more)]
    return spark.createDataFrame(rows + [(None, "no id", 7), (3, "again", 8)], "doc_id long, text string, Length int")


def direct(text, end):
    return tokenizing.id_encoder(TOKENIZER).tokenizer.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_the_library():
    rnd = random.Random(2)
    texts = [t or "" for t in TEXTS] + ["".join(rnd.choice(" \n\t'sltrve1a²é日!.,́\x1c\x1f\x85\xa0\x0b") for _ in range(rnd.randint(0, 60)))
                                        for _ in range(800)]
    one = tokenizing.IdEncoder(TOKENIZER, chunks=50, pieces=20)
    for _ in range(2):
        assert [a.tolist() + [9] for a in one.encode_all(texts)] == [direct(t, 9) for t in texts]


def test_token_store_round_trip(spark, docs):
    path = tempfile.mkdtemp(prefix="run-") + "/store"
    token_store.write_store(docs, path, TOKENIZER, end_id=2, partitions=4, shard_bytes=400)
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0]))
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_store.digest(spark, path).collect()))
    assert [g[1] for g in got] == [r[0] for r in rows]
    start = 0
    by_id = {}
    for r in rows:
        by_id.setdefault(r[0], []).append((len(direct(r[1], 2)), crc(direct(r[1], 2))))
    for s, doc_id, n, c in got:
        assert s == start and (n, c) in by_id[doc_id]
        start += n
    shards = spark.read.parquet(f"{path}/shards")
    assert shards.count() > 4 and shards.select("dictionary").distinct().count() == 1
    few = token_store.read_store(spark, path, [4, 101, 10 ** 9])
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in few.collect()} == {
        4: direct(TEXTS[4], 2), 101: direct(next(r[1] for r in rows if r[0] == 101), 2)}


def test_token_store_empty_and_foreign_dictionary(spark, docs):
    path = tempfile.mkdtemp(prefix="run-") + "/store"
    token_store.write_store(docs.limit(0), path, TOKENIZER)
    assert token_store.digest(spark, path).count() == 0
    other = tempfile.mkdtemp(prefix="run-") + "/store"
    token_store.write_store(docs, other, TOKENIZER)
    spark.read.parquet(f"{other}/dictionary").withColumn("hash", F.lit("0")).write.parquet(f"{path}/changed/dictionary")
    spark.read.parquet(f"{other}/shards").write.parquet(f"{path}/changed/shards")
    with pytest.raises(Exception, match="was written with dictionary"):
        token_store.read_store(spark, f"{path}/changed").count()


def test_cuts():
    for n in [*range(0, 70), 4097, 10 ** 6 + 3]:
        for top in (1, 8, 2048):
            own = packing.cuts(n, top)
            assert sum(own) == n and all(x & (x - 1) == 0 and 1 <= x <= top for x in own)
            assert own == sorted(own, reverse=True) and all(own.count(x) == 1 for x in own if x < top)
    with pytest.raises(ValueError):
        packing.cuts(5, 6)


def test_packing_puts_each_id_in_one_piece(spark, docs):
    packed = packing.pack(docs, TOKENIZER, end_id=1, max_length=64)
    rows = packed.collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    assert all(r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 64 and len(r.ids) == 4 * r.length for r in rows)
    texts = {r.doc_id: r.text for r in docs.filter("doc_id <> 3").collect()}
    for doc_id, text in texts.items():
        own = sorted((r.start, r.ids) for r in rows if r.doc_id == doc_id)
        assert np.frombuffer(b"".join(i for _, i in own), "<u4").tolist() == direct(text, 1)
        assert [s for s, _ in own] == np.cumsum([0, *[len(i) // 4 for _, i in own]])[:-1].tolist()
    assert sum(r.length for r in rows if r.doc_id == 3) == len(direct(TEXTS[3], 1)) + len(direct("again", 1))
    path = tempfile.mkdtemp(prefix="run-") + "/buckets"
    packing.write_buckets(packed, path)
    back = spark.read.parquet(path)
    assert back.count() == len(rows) and back.filter("length = 64").count() == sum(r.length == 64 for r in rows)
    assert packing.pack(docs.limit(0), TOKENIZER).count() == 0


PAGES = [(5, "http://a.org/x y\r\n", "<p>" + "é" * 80), (3, None, "<p>" + "é" * 80), (9, "http://b.org/?q=1", "<p>" + "é" * 80),
         (4, "http://b.org", None), (6, "bad", ""), (7, "http://c.org/z", "same short"), (8, "http://c.org/z", "same short"),
         (1, "http://d.org/", "WARC/1.1\r\n\r\n fake \r\n\r\n" * 20), (None, "http://e.org/", "<p>" + "é" * 80),
         (2, "http://d.org/", "q" * 300_000), (2, "http://d.org/", "q" * 300_000)]


def test_warc_round_trip(spark):
    path = tempfile.mkdtemp(prefix="run-") + "/warc"
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, digest string").repartition(3)
    warc.write_archives(pages, path)
    records = warc.read_archives(spark, path)
    assert records.filter("type = 'error'").count() == 0 and records.count() == 3 * len(PAGES)
    captures = warc.assemble(records)
    rows = captures.collect()
    assert len(rows) == len(PAGES) and all(len(r.requests) == 1 and len(r.others) == 1 for r in rows)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.digest(captures).collect()), key=str)
    want, seen = [], set()
    for page_id, _, html in sorted(PAGES, key=lambda p: (p[0] is None, p[0])):
        raw = (html or "").encode()
        first = min(p for p, _, h in PAGES if (h or "") == (html or "") and p is not None)
        again = len(raw) >= 100 and html in seen
        seen.add(html)
        want.append((page_id, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    assert got == sorted(want, key=str)
    none = tempfile.mkdtemp(prefix="run-") + "/none"
    warc.write_archives(pages.limit(0), none)
    assert warc.digest(warc.assemble(warc.read_archives(spark, none))).count() == 0


def record(kind, rid, block=b"x", **headers):
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}"]
    for name, values in headers.items():
        lines += [f"WARC-{name.replace('_', '-')}: {v}" for v in ([values] if isinstance(values, str) else values)]
    return ("WARC/1.0\r\n" + "\r\n".join([*lines, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def test_transactions_of_foreign_archives(spark):
    folder = tempfile.mkdtemp(prefix="run-")
    parts = [record("warcinfo", "<i>"), record("response", "<r1>", b"one", Concurrent_To="<q1>"), record("request", "<q1>"),
             record("metadata", "<m1>", Concurrent_To="<q1>"),  # through the request
             record("resource", "<r2>", b"two"), record("metadata", "<m2>", Concurrent_To=["<zz>", "<r2>"]),
             record("metadata", "<m3>", Concurrent_To="<r2>"), record("request", "<q9>", Concurrent_To="<missing>")]
    with open(f"{folder}/members.warc.gz", "wb") as f:
        f.write(b"".join(gzip.compress(p) for p in parts[:4]))
    with open(f"{folder}/plain.warc", "wb") as f:
        f.write(b"".join(parts[4:]) + b"WARC/1.0\r\nContent-Length: 50\r\n\r\ncut")
    with open(f"{folder}/broken.warc.gz", "wb") as f:
        f.write(gzip.compress(record("response", "<r3>", b"three"))[:-12])
    with open(f"{folder}/empty.warc", "wb"):
        pass
    records = warc.read_archives(spark, folder)
    assert records.filter("type = 'error'").count() == 2
    rows = {(r.record_id, r.part): r for r in warc.assemble(records, max_members=1).collect()}
    one, two = ([r for (i, _), r in rows.items() if i == name] for name in ("<r1>", "<r2>"))
    members = lambda r: {m.record_id for m in [*(r.requests or ()), *(r.others or ())]}
    assert all(bytes(r.response.payload) == b"one" and len(members(r)) <= 2 for r in one)
    assert set().union(*map(members, one)) == {"<q1>", "<m1>"}
    assert set().union(*map(members, two)) == {"<m2>", "<m3>"}
    assert rows["<q9>", 0].response is None and rows["<i>", 0].response is None


def day(text):
    return datetime.date.fromisoformat(text) if text else None


ENTRIES = [("a", "block", "domain", "evil.org", "add", "2020-01-01"), ("a", "block", "domain", "evil.org", "add", "2020-02-01"),
           ("a", "block", "domain", "evil.org", "remove", "2020-03-01"), ("a", "block", "domain", "evil.org", "add", "2020-06-01"),
           ("b", "block", "domain", "evil.org", "add", "2020-02-15"), ("b", "block", "domain", "evil.org", "remove", "2020-02-15"),
           ("c", "allow", "host", "good.evil.org", "add", "2020-01-15"), ("c", "block", "host", "good.evil.org", "add", "2020-07-01"),
           ("d", "block", "prefix", "good.evil.org/bad/dir", "add", "2020-01-01"), ("d", "block", "prefix", "good.evil.org/bad/dir", "remove", "2020-01-10"),
           ("x", "block", "domain", None, "add", "2020-01-01"), ("x", "block", "domain", "evil.org", "add", None),
           ("x", "block", "domain", "evil.org", "rename", "2020-01-01"), ("e", "block", "host", "never.org", "remove", "2020-01-01")]
CASES = [("http://evil.org/", "2019-12-31", "allow", ""), ("http://evil.org/", "2020-01-01", "block", "a"),
         ("http://EVIL.org:80/x", "2020-02-29", "block", "a,b"), ("http://www.evil.org./", "2020-03-01", "block", "b"),
         ("http://u:p@www.evil.org", "2020-06-01", "block", "a,b"), ("http://good.evil.org/", "2020-01-14", "block", "a"),
         ("http://good.evil.org/", "2020-01-15", "allow", "c"), ("http://good.evil.org/bad/dir/x", "2020-01-09", "block", "d"),
         ("http://good.evil.org/bad/dirt", "2020-01-09", "block", "a"), ("http://good.evil.org/bad//dir?q", "2020-01-09", "block", "d"),
         ("http://good.evil.org/bad/dir", "2020-01-10", "block", "a"), ("http://good.evil.org/", "2020-08-01", "allow", "c"),
         ("http://notevil.org/", "2020-02-01", "allow", ""), (None, "2020-02-01", "allow", ""), ("no url", "2020-02-01", "allow", ""),
         ("http://evil.org/", None, "allow", ""), ("http://never.org/", "2020-02-01", "allow", "")]


def test_url_lists_hold_at_their_date(spark):
    schema = "list_name string, action string, kind string, value string, event string, day date"
    entries = spark.createDataFrame([(*e[:5], day(e[5])) for e in ENTRIES], schema)
    captures = spark.createDataFrame([(i, u, day(d), "v") for i, (u, d, *_) in enumerate(CASES)] + [(1, CASES[1][0], day(CASES[1][1]), "v")],
                                     "page_id long, url string, fetched date, Verdict string")
    out = url_filter.filter_urls(captures, entries)
    assert "Verdict" not in out.columns
    got = sorted((r.page_id, r.verdict, r.matched_lists or "") for r in out.collect())
    want = [(i, v, lists) for i, (_, _, v, lists) in enumerate(CASES)]
    assert got == sorted(want + want[1:2])
    assert {r.verdict for r in url_filter.filter_urls(captures, entries.limit(0)).collect()} == {"allow"}
    assert url_filter.filter_urls(captures.limit(0), entries).count() == 0


def test_intervals_are_disjoint(spark):
    rnd = random.Random(3)
    start = datetime.date(2020, 1, 1)
    events = [("l", "block", "host", rnd.choice("ab"), rnd.choice(["add", "remove"]), start + datetime.timedelta(rnd.randint(0, 60)))
              for _ in range(120)]
    rows = url_filter.intervals(spark.createDataFrame(events, "list_name string, action string, kind string, value string, event string, day date")).collect()
    for value in "ab":
        on = False
        for n in range(70):
            at = start + datetime.timedelta(n)
            today = {e[4] for e in events if e[3] == value and e[5] == at}
            on = True if "add" in today else False if today else on
            active = [r for r in rows if r.value == value and r.valid_from <= at and (r.valid_to is None or at < r.valid_to)]
            assert len(active) == on


def plain(value):
    return value.isoformat() if hasattr(value, "isoformat") else value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "conversations", "embeddings"):
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda found, names: sorted(str([plain(r[names.index(c)]) for c in sorted(names)]) for r in found)
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), want.columns)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES][:1] == ["quality_rules"] and len(corpus_pipeline.STAGES) == 5
    base = tempfile.mkdtemp(prefix="run-")
    inputs = []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        inputs.append(docs)
        out = stage(spark, docs, SF)
        out.write.parquet(f"{base}/{number}")
        docs = spark.read.parquet(f"{base}/{number}")
        if number < 4:
            assert docs.columns == columns and 0 < docs.count() <= seen
            seen = docs.count()
    assert inputs[1].count() == inputs[2].count()  # lines go, documents stay
    assert docs.agg(F.sum("length")).first()[0] == sum(len(direct(r.text, 1)) for r in inputs[4].collect())
    run = corpus_pipeline.run(spark, SF)
    drop = ["sequence_id"]
    assert run.drop(*drop).exceptAll(docs.drop(*drop)).isEmpty() and docs.drop(*drop).exceptAll(run.drop(*drop)).isEmpty()


def test_pipeline_with_odd_documents(spark):
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "x " * 40, "en", "s", 80), (2, "", "en", "s", 0)],
                                "doc_id long, text string, lang string, source string, n_chars long")
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SF)
        assert docs.columns == odd.columns
    assert corpus_pipeline.STAGES[4][1](spark, docs, SF).count() == 0
