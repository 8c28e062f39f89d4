"""End-to-end: a WARC written here -> records -> pages -> inverted links -> page documents."""
import gzip
import os
import tempfile

from archivesearch.operators import extract as X
from archivesearch.plans.indexing import index_pages
from archivesearch.sources.archive import _http_parts, is_archive, read_archive, read_archive_list, with_authority


def warc_record(url, date, html, rtype="response", ctype="text/html; charset=utf-8"):
    body = html.encode("utf-8")
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: {ctype}\r\nContent-Length: {len(body)}\r\n\r\n").encode() + body
    head = (f"WARC/1.0\r\nWARC-Type: {rtype}\r\nWARC-Target-URI: {url}\r\nWARC-Date: {date}\r\n"
            f"Content-Length: {len(http)}\r\n\r\n").encode()
    return gzip.compress(head + http + b"\r\n\r\n")


def test_suffix_filter():
    assert is_archive("x/warc.gz") and is_archive("arc.GZ") and not is_archive("file.txt")


def test_warc_to_documents(spark):
    d = tempfile.mkdtemp(prefix="warc-")
    a = '<html><head><title>Home</title></head><body><p>Hello <a href="/b">to b</a> <a href="http://other.pt/">x</a></p></body></html>'
    b = '<html><head><title>B</title></head><body><a href="http://publico.pt/">back home</a></body></html>'
    with open(os.path.join(d, "test.warc.gz"), "wb") as f:
        f.write(warc_record("http://publico.pt", "1996-10-13T18:03:44Z", a))
        f.write(warc_record("http://publico.pt/b", "1996-10-13T18:05:00Z", b))
        f.write(warc_record("http://publico.pt/c.css", "1996-10-13T18:06:00Z", "p{}", ctype="text/css"))
    with open(os.path.join(d, "notes.txt"), "w") as f:
        f.write("not an archive")
    recs = read_archive(spark, d)
    assert recs.count() == 3
    counts = {r.disposition: r.records for r in X.disposition_counts(recs).collect()}
    assert counts == {"accepted": 2, "discarded": 1}
    docs = {r.url: r for r in index_pages(recs, policy="none").collect()}
    home = docs["http://publico.pt/"]
    assert home.title == "Home" and home.surt_url == "(pt,publico," and home.tstamp == "19961013180344"
    assert home.id == "19961013180344/FhcAj9+g5IrKjL+HJyyf3g=="
    assert home.inlinks == 1 and home.anchor == "back home " and home.outlinks == 2
    assert docs["http://publico.pt/b"].inlinks == 1 and docs["http://publico.pt/b"].anchor == "to b "


def test_missing_archives_and_lists(spark):
    d = tempfile.mkdtemp(prefix="warc-")
    good = os.path.join(d, "good.warc.gz")
    with open(good, "wb") as f:
        f.write(warc_record("http://publico.pt", "1996-10-13T18:03:44Z", "<title>x</title>"))
    missing = os.path.join(d, "missing.warc.gz")
    rows = read_archive(spark, missing).collect()
    assert len(rows) == 1 and "missing.warc.gz" in rows[0].error
    with open(os.path.join(d, "list.txt"), "w") as f:
        f.write(f"{good}\n\n  {missing}  \n{good}\n")
    recs = read_archive_list(spark, os.path.join(d, "list.txt"))
    assert sorted(r.error is None for r in recs.select("error").collect()) == [False, True, True]
    assert {r.disposition: r.records for r in X.disposition_counts(recs).collect()} == {"accepted": 2, "error": 1}


def test_listed_paths_keep_scheme_and_host():
    assert with_authority("/d/a.gz", "hdfs://host:9000/d") == "hdfs://host:9000/d/a.gz"
    assert with_authority("bucket/a.gz", "s3://bucket/") == "s3://bucket/a.gz"
    assert with_authority("/d/a.gz", "/d") == "/d/a.gz"


def test_status_range():
    assert _http_parts(b"HTTP/1.1 1001 No\r\n\r\n")[0] is None and _http_parts(b"HTTP/1.1  204\r\nA: b\r\na: c\r\n\r\n")[:2] == ("204", {"a": "b"})


def test_submitted_jobs(spark):
    from archivesearch.operators import search as S
    from archivesearch.plans.corpus import read_corpus
    from archivesearch.plans.job import main
    d = tempfile.mkdtemp(prefix="warc-")
    with open(os.path.join(d, "a.warc.gz"), "wb") as f:
        f.write(warc_record("http://publico.pt", "1996-10-13T18:03:44Z", '<title>Home</title><a href="/b">to b</a>'))
        f.write(warc_record("http://publico.pt/b", "1996-10-13T18:05:00Z", "<title>B</title>other words"))
    main(["pages", d, f"{d}/pages", "--collection", "TESTE"])
    main(["links", f"{d}/pages", f"{d}/links"])
    main(["docs", f"{d}/pages", f"{d}/links", f"{d}/docs"])
    main(["index", f"{d}/pages", f"{d}/corpus"])
    docs = {r.url: r for r in spark.read.json(f"{d}/docs").collect()}
    assert docs["http://publico.pt/b"].anchor == "to b " and docs["http://publico.pt/"].collection == "TESTE"
    c = read_corpus(spark, f"{d}/corpus")
    res, _ = S.page_search(spark.createDataFrame([(1, '"other words"')], "qid long, q string"), c.docs, c.versions, c.index)
    assert [(r.title, r.collection) for r in res.collect()] == [("B", "TESTE")]
