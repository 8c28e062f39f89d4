"""The archive reader and sink: ranges, damage, pushed filters, bounded memory, commits."""
import gzip
import io
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from archivesearch.operators import extract as X
from archivesearch.sources.archive import ArchiveWriter, read_archive, write_archive
from archivesearch.sources.records import RecordReader, Source, find_member


def record(n, body=None, length=None, kind="response", newline=b"\r\n"):
    body = b"payload %d " % n * 40 if body is None else body
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
    head = [b"WARC/1.0", b"WARC-Type: " + kind.encode(), b"WARC-Target-URI: http://a.pt/%d" % n, b"WARC-Date: 2020-01-01T00:00:00Z",
            b"Content-Length: " + (str(len(http)).encode() if length is None else length)]
    return newline.join([*head, b"", b""]) + http + b"\r\n\r\n"


def arc(n):
    http = b"HTTP/1.0 200 OK\nContent-Type: text/html\n\narc %d" % n
    return b"http://a.pt/%d 1.2.3.4 20200101000000 text/html %d\n" % (n, len(http)) + http + b"\n"


def read(data, splits=1, **options):
    reader, rows = RecordReader("x.warc.gz", **options), []
    step = -(-len(data) // splits) or 1
    for start in range(0, max(1, len(data)), step):
        rows += reader.read(Source(io.BytesIO(data), len(data)), start, start + step)
    return rows


def urls(rows):
    return [r[3] for r in rows if r[-1] is None]


def errors(rows):
    return [r[-1] for r in rows if r[-1] is not None]


def test_ranges_give_the_same_rows():
    rnd = random.Random(4)
    members = [gzip.compress(record(i, rnd.randbytes(rnd.choice([0, 10, 3000, 90_000])))) for i in range(60)]
    data = b"".join(members)
    one = read(data)
    assert urls(one) == [f"http://a.pt/{i}" for i in range(60)] and not errors(one)
    for splits in (2, 16, 300, len(members) * 50):
        assert read(data, splits) == one
    single = gzip.compress(b"".join(gzip.decompress(m) for m in members))
    assert [r[3:] for r in read(single)] == [r[3:] for r in one] and [r[3:] for r in read(single, 16)] == [r[3:] for r in one]
    arcs = gzip.compress(b"filedesc://x.arc 0.0.0.0 20200101000000 text/plain 4\n1 0\n" + b"\n") + b"".join(gzip.compress(arc(i)) for i in range(40))
    assert urls(read(arcs)) == [f"http://a.pt/{i}" for i in range(40)] and read(arcs, 16) == read(arcs)


def test_damage_costs_its_record_only():
    good = [record(i) for i in range(20)]
    bad = {3: record(3, length=b"many"), 7: record(7)[:60], 11: record(11)[:-300], 15: b"garbage\n" + record(15)[:0]}
    members = [gzip.compress(bad.get(i, good[i])) for i in range(20)]
    cut = bytearray(members[5])
    cut[len(cut) // 2] ^= 0x40
    members[5] = bytes(cut)
    wanted = [f"http://a.pt/{i}" for i in range(20) if i not in (3, 5, 7, 11, 15)]
    for splits in (1, 7, 40):
        rows = read(b"".join(members), splits)
        assert sorted(urls(rows)) == sorted(wanted) and len(errors(rows)) == 5, splits
    rows = read(b"".join(members[:6]) + b"lost bytes " * 9 + b"".join(members[6:]))
    assert urls(rows) == wanted and len(errors(rows)) == 6 or len(errors(rows)) == 5  # the damaged member may swallow them
    rows = read(b"".join(members[8:11]) + b"lost bytes " * 9 + b"".join(members[12:15]))
    assert len(urls(rows)) == 6 and errors(rows) == ["no member begins where the one before ends"]
    assert not errors(read(members[0] + bytes(512) + members[1])) and len(urls(read(members[0] + bytes(512) + members[1]))) == 2


def test_damage_within_one_member():
    parts = [record(i) for i in range(12)]
    parts[2], parts[5] = record(2, length=b"x"), record(5, length=b"99999")   # the second swallows what follows
    parts[8] = record(8, length=b"20")                                        # too short
    rows = read(gzip.compress(b"".join(parts)))
    assert urls(rows) == [f"http://a.pt/{i}" for i in range(12) if i not in (2, 5, 8)] and len(errors(rows)) == 3
    rows = read(gzip.compress(b"".join(parts))[:-40])
    assert len(errors(rows)) >= 1 and set(urls(rows)) <= {f"http://a.pt/{i}" for i in range(12)}


def test_the_error_budget():
    data = gzip.compress(record(0, length=b"x")) * 50 + gzip.compress(record(1))
    assert errors(read(data, max_errors=10))[-1] == "gave up after 10 errors" and len(errors(read(data, max_errors=10))) == 11
    assert urls(read(data, max_errors=51)) == ["http://a.pt/1"]


def test_odd_files():
    assert read(b"") == [] and errors(read(b"no gzip at all")) and errors(read(gzip.compress(record(1))[:30]))
    assert urls(read(gzip.compress(record(1, newline=b"\n")))) == ["http://a.pt/1"]
    assert read(gzip.compress(b"")) == [] and read(gzip.compress(b"\r\n\r\n")) == []
    inner = gzip.compress(record(7))
    assert urls(read(gzip.compress(record(1, inner)) + gzip.compress(record(2)), 50)) == ["http://a.pt/1", "http://a.pt/2"]


def test_a_large_member_streams():
    """Payloads that nobody wants are passed over, and one record's payload is held at a time."""
    import tracemalloc
    big = bytes(40_000_000)
    data = gzip.compress(b"".join(record(i, big) for i in range(4)), 1)
    tracemalloc.start()
    rows = read(data, with_payload=lambda row: row[3].endswith("/2") and False)
    peak = tracemalloc.get_traced_memory()[1]
    assert urls(rows) == [f"http://a.pt/{i}" for i in range(4)] and all(r[8] is None for r in rows) and peak < 20_000_000
    tracemalloc.reset_peak()
    reader = RecordReader("x")
    assert sum(len(r[8]) for r in reader.read(Source(io.BytesIO(data), len(data)))) == 160_000_000
    assert tracemalloc.get_traced_memory()[1] < 260_000_000
    tracemalloc.stop()
    assert errors(read(data, max_record=1_000_000)) == ["a payload of 40000000 bytes is over the bound"] * 4


def test_find_member_is_not_misled():
    data = gzip.compress(record(1)) + b"\x1f\x8b\x08\x00junk" + gzip.compress(b"no record") + gzip.compress(record(2))
    source = Source(io.BytesIO(data), len(data))
    second = len(data) - len(gzip.compress(record(2)))
    assert find_member(source, 0) == 0 and find_member(source, 1) == second
    assert find_member(source, 1, second) is None and find_member(source, second + 1) is None


# ------------------------------------------------------------------ in Spark

SCHEMA = "record_type string, url string, record_date string, status string, content_type string, headers map<string,string>, payload binary"


def table(spark, n=200):
    rows = [(("response", "request", "revisit")[i % 3], f"http://a.pt/{i}", "2020-01-01T00:00:00Z", ("200", "404", "206")[i % 3 if i % 2 else 0],
             ("text/html", "text/css", None)[i % 5 % 3], {"x-n": str(i)}, b"<p>%d</p>" % i * (i % 50)) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def folder():
    return tempfile.mkdtemp(prefix="run-")


@pytest.mark.parametrize("options", [{}, {"members": "file"}, {"fileBytes": "3000"}])
def test_round_trip(spark, options):
    path = folder()
    df = table(spark).repartition(3)
    write_archive(df, path, **options)
    files = os.listdir(path)
    assert all(f.endswith(".warc.gz") and not f.startswith("_") for f in files) and (len(files) > 10) == ("fileBytes" in options)
    back = read_archive(spark, path, splitBytes=2000)
    key = lambda r: (r.record_type, r.url, r.record_date, bytes(r.payload) if r.record_type != "request" else b"")
    assert sorted(map(key, back.collect())) == sorted(map(key, df.collect()))
    answer = back.filter("record_type <> 'request'").select("url", "status", "content_type").collect()
    assert sorted(map(str, answer)) == sorted(map(str, df.filter("record_type <> 'request'").select("url", "status", "content_type").collect()))


def test_append_overwrite_and_failed_jobs(spark):
    path = folder()
    write_archive(table(spark, 10), path)
    write_archive(table(spark, 5), path)
    assert read_archive(spark, path).count() == 15
    write_archive(table(spark, 7), path, mode="overwrite")
    assert read_archive(spark, path).count() == 7
    broken = table(spark, 50).withColumn("status", F.when(F.col("url").endswith("/40"), F.raise_error(F.lit("no"))).otherwise(F.col("status")))
    with pytest.raises(Exception, match="no"):
        write_archive(broken, path)
    assert read_archive(spark, path).count() == 7  # what a failed job wrote has no archive's name
    with pytest.raises(ValueError):
        ArchiveWriter({"path": path, "members": "x"}, table(spark, 1).schema, False)


def test_filters_are_pushed(spark):
    path = folder()
    write_archive(table(spark), path)
    everything = read_archive(spark, path).collect()
    conditions = {
        "record_type = 'response'": lambda r: r.record_type == "response",
        "status like '2%' and url like '%9'": lambda r: bool(r.status) and r.status[0] == "2" and r.url.endswith("9"),
        "content_type is null": lambda r: r.content_type is None,
        "content_type is not null and record_type in ('request', 'revisit')": lambda r: r.content_type is not None and r.record_type in ("request", "revisit"),
        "not (status = '200')": lambda r: r.status is not None and r.status != "200",
        "status <=> null": lambda r: r.status is None,
        "url like '%a.pt/1%'": lambda r: "a.pt/1" in r.url,
        "warc_offset > 500 and warc_offset <= 3000": lambda r: 500 < r.warc_offset <= 3000,
        "record_type = 'response' or status = '404'": lambda r: r.record_type == "response" or r.status == "404"}
    for sql, test in conditions.items():
        got = read_archive(spark, path, splitBytes=700).filter(sql)
        assert sorted(map(str, got.collect())) == sorted(str(r) for r in everything if test(r)), sql
    df = read_archive(spark, path).filter("status like '2%' and record_type = 'response'")
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "PushedFilters: [IsNotNull(status), IsNotNull(record_type), StringStartsWith(status,2), EqualTo(record_type,response)]" in plan
    assert "Filter (" not in plan


def test_payloads_of_refused_records_stay_behind(spark):
    path = folder()
    write_archive(table(spark), path)
    cfg = X.ExtractConfig()
    all_rows, few = read_archive(spark, path), read_archive(spark, path, accepted=cfg)
    counts = lambda df: sorted(map(str, X.disposition_counts(df).collect()))
    assert counts(all_rows) == counts(few)
    accepted = X.with_disposition(all_rows, cfg).filter("disposition = 'accepted'").select("url")
    kept = few.filter("payload is not null").select("url")
    assert accepted.exceptAll(kept).isEmpty() and kept.count() < all_rows.count() / 2
    pages = lambda df: sorted(map(str, X.build_page_data(df, cfg).collect()))
    assert pages(all_rows) == pages(few)
    assert read_archive(spark, path, payload="none").filter("payload is not null").isEmpty()
    with pytest.raises(Exception, match="payload must be"):
        read_archive(spark, path, payload="some").count()


def test_modes_and_missing_files(spark):
    path = folder()
    with open(f"{path}/a.warc.gz", "wb") as f:
        f.write(gzip.compress(record(1)) + gzip.compress(record(2, length=b"x")) + gzip.compress(record(3)))
    rows = read_archive(spark, path).collect()
    assert sorted(r.url for r in rows if r.error is None) == ["http://a.pt/1", "http://a.pt/3"] and sum(r.error is not None for r in rows) == 1
    with pytest.raises(Exception, match="Content-Length"):
        read_archive(spark, path, mode="FAILFAST").collect()
    assert read_archive(spark, f"{path}/none.warc.gz").collect()[0].warc_offset is None


def test_counters_are_counted_on_the_write(spark):
    from pyspark.sql import Observation
    path = folder()
    write_archive(table(spark), path)
    records, seen = read_archive(spark, path, accepted=X.ExtractConfig()), Observation()
    X.build_page_data(records, observation=seen).write.parquet(f"{path}/pages")
    want = {r.disposition: r.records for r in X.disposition_counts(read_archive(spark, path)).collect()}
    assert {k: v for k, v in seen.get.items() if k in want} == want and seen.get["records"] == 200
    assert spark.read.parquet(f"{path}/pages").count() == want["accepted"]
