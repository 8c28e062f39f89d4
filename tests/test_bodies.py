"""Body codings, type detection and character sets on single payloads, and through the extraction."""
import gzip
import zlib

import pytest

from archivesearch.operators import bodies as B
from archivesearch.operators import extract as X

PAGE = ("<html><head><title>Página</title></head><body>" + "texto é <a href='/x'>link</a> " * 400 + "</body></html>").encode("utf-8")


def chunked(data, n=777, extension=b""):
    parts = [data[a:a + n] for a in range(0, len(data), n)]
    return b"".join(b"%X%s\r\n%s\r\n" % (len(p), extension, p) for p in parts) + b"0\r\nTrailer: x\r\n\r\n"


def raw_deflate(data):
    c = zlib.compressobj(9, zlib.DEFLATED, -15)
    return c.compress(data) + c.flush()


@pytest.mark.parametrize("payload, transfer, content", [
    (PAGE, None, None), (PAGE, "identity", "none"), (gzip.compress(PAGE), None, "gzip"), (gzip.compress(PAGE), None, " X-GZIP "),
    (zlib.compress(PAGE), None, "deflate"), (raw_deflate(PAGE), None, "deflate"), (chunked(PAGE), "chunked", None),
    (chunked(PAGE, 1), "chunked", None), (chunked(PAGE, 100_000, b" ; a=b"), "Chunked", None), (chunked(gzip.compress(PAGE)), "chunked", "gzip"),
    (chunked(zlib.compress(gzip.compress(PAGE)), 13), "chunked", "gzip, deflate"), (chunked(gzip.compress(PAGE)), "gzip, chunked", None),
    (gzip.compress(PAGE[:99]) + gzip.compress(PAGE[99:]), None, "gzip"), (gzip.compress(PAGE) + b"\0\0padding", None, "gzip"),
    # served as coded, stored without
    (PAGE, "chunked", "gzip"), (PAGE, None, "deflate")])
def test_codings(payload, transfer, content):
    assert B.decode_body(payload, transfer, content) == PAGE


@pytest.mark.parametrize("size", [0, 1, B.CHUNK - 1, B.CHUNK, B.CHUNK + 1, 5 * B.CHUNK])
def test_sizes_around_the_chunk(size):
    data = bytes(i * 7 % 251 for i in range(size))
    for n in (1000, B.CHUNK, 10 * B.CHUNK):
        assert B.decode_body(chunked(data, n), "chunked", None) == data
    assert B.decode_body(chunked(gzip.compress(data)), "chunked", "gzip") == data
    assert B.decode_body(b"", "chunked", "gzip") == b""


@pytest.mark.parametrize("payload, transfer, content, says", [
    (PAGE, None, "compress", "unknown coding"), (PAGE, "weird", None, "unknown coding"), (gzip.compress(PAGE)[:-9], None, "gzip", "cut off"),
    (gzip.compress(PAGE)[:60] + b"\xff" * 60, None, "gzip", "damaged|cut off"), (chunked(PAGE)[:-400], "chunked", None, "within a chunk"),
    (chunked(PAGE, 100).replace(b"64\r\n", b"zz\r\n", 2).replace(b"zz\r\n", b"64\r\n", 1), "chunked", None, "chunk size"),
    (gzip.compress(bytes(30_000_000)), None, "gzip", "over 1000000 bytes"), (zlib.compress(gzip.compress(bytes(3_000_000))), None, "gzip, deflate", "over"),
    (b"\x00\x01\x02\x03" * 30, None, "deflate", "not deflated|damaged")])
def test_bodies_that_are_errors(payload, transfer, content, says):
    with pytest.raises(B.BodyError, match=says):
        B.decode_body(payload, transfer, content, max_body=1_000_000)


def test_a_bomb_is_never_held():
    import tracemalloc
    bomb = gzip.compress(bytes(400_000_000), 9)
    tracemalloc.start()
    with pytest.raises(B.BodyError):
        B.decode_body(bomb, None, "gzip", max_body=5_000_000)
    assert tracemalloc.get_traced_memory()[1] < 30_000_000
    tracemalloc.stop()


@pytest.mark.parametrize("body, served, kind", [
    (b"  <!-- c --><!DOCTYPE HTML><html>", "text/plain", "text/html"), (b"<html>", None, "text/html"), (b"<html>", "application/pdf", "text/html"),
    (b"<html>", "text/html; charset=utf-8", "text/html"), (b"plain words", "text/html", "text/html"), (b"plain words", None, "text/plain"),
    (b"plain words", "application/octet-stream", "text/plain"), (b"%PDF-1.4", "text/html", "application/pdf"), (b"\x89PNG\r\n\x1a\n\0", "text/html", "image/png"),
    (b"PK\x03\x04", "application/vnd.oasis.opendocument.text", "application/vnd.oasis.opendocument.text"), (b"PK\x03\x04", "text/html", "application/zip"),
    (b"\x00\x01\x02binary", None, "application/octet-stream"), (b"", "text/html", "text/html"), (b"", None, "text/plain"),
    (b"<?xml version='1.0'?><!-- x --><html xmlns='a'>", "application/octet-stream", "application/xhtml+xml"), (b"<?xml version='1.0'?><rss>", "", "application/xml"),
    ("\ufeff<html>".encode("utf-16-le"), None, "text/html"), (b"<p>", "text/css", "text/css"), (b"<abbr>", "text/plain", "text/plain")])
def test_types(body, served, kind):
    assert B.detect_type(body, served) == kind


WRITTEN = {
    "windows-1252": ["O meu perfil, formação e eventos, ligações úteis para a língua portuguesa", "Ça été très élevé à l'école", "Größere Straßen führen über die Brücke"],
    "windows-1250": ["Zażółć gęślą jaźń, wszystkie książki są już w języku polskim", "Příliš žluťoučký kůň úpěl ďábelské ódy"],
    "windows-1251": ["Это просто проверка русского текста", "Проверка"], "koi8-r": ["Это просто проверка русского текста"],
    "iso-8859-5": ["Это просто проверка русского текста"], "windows-1253": ["Αυτό είναι ένα απλό κείμενο στα ελληνικά"],
    "windows-1254": ["Türkçe yazılmış bir metin, ışık ve şehir"], "windows-1255": ["זהו טקסט פשוט בעברית"], "windows-1256": ["هذا نص بسيط باللغة العربية"]}


@pytest.mark.parametrize("charset, text", [(c, t) for c, ts in WRITTEN.items() for t in ts])
def test_charsets(charset, text):
    page = f"<html><title>{text}</title>"
    data = page.encode(charset)
    assert B.body_text(data) == (page, charset)                       # guessed
    assert B.body_text(data, charset) == (page, charset)              # served
    named = page.replace("<html>", f"<html><META http-equiv=Content-Type content='text/html; charset={charset}'>")
    assert B.body_text(named.encode(charset)) == (named, charset)     # named by the page
    assert B.body_text(page.encode("utf-8"), charset) == (page, "utf-8")   # served wrongly
    assert B.body_text(page.encode("utf-16")) == (page, "utf-16-le")
    assert B.body_text(b"\xef\xbb\xbf" + page.encode("utf-8"), charset) == (page, "utf-8")


def test_charset_names_and_rest():
    assert B.known_charset("no-such-set") is None and B.known_charset("base64") is None and B.known_charset("ISO-8859-1") == "windows-1252"
    assert B.charset_of(b"only ascii", "iso-8859-1") == "utf-8"
    assert B.body_text("日本語のテキスト".encode("shift_jis"), "Shift_JIS")[0] == "日本語のテキスト"
    assert B.body_text(b"\xff\x81\x8d", "no-such-set")[0]


def test_extraction_of_payloads(spark):
    rows = [("http://a.pt/1", gzip.compress(PAGE), "text/html", {"content-encoding": "gzip"}), ("http://a.pt/2", chunked(PAGE), "text/html", {"transfer-encoding": "chunked"}),
            ("http://a.pt/3", gzip.compress(PAGE), "text/html", {}), ("http://a.pt/4", gzip.compress(PAGE)[:50], "text/html", {"content-encoding": "gzip"}),
            ("http://a.pt/5", PAGE, "text/html", {"content-encoding": "br, gzip"}), ("http://a.pt/6", b"%PDF-1.4 \x00\x01", "text/html", {}),
            ("http://a.pt/7", PAGE, "text/css", {}), ("http://a.pt/8", None, "text/html", {}), ("http://a.pt/9", b"", "text/html", None)]
    records = spark.createDataFrame([(u, "response", "20200101", "200", t, h, p, "w", i) for i, (u, p, t, h) in enumerate(rows)],
                                    "url string, record_type string, record_date string, status string, content_type string, "
                                    "headers map<string,string>, payload binary, warc_name string, warc_offset long")
    out = {r.c_url[-1]: r for r in X.extract_records(records).collect()}
    assert {k: r.disposition for k, r in out.items()} == {"1": "accepted", "2": "accepted", "3": "accepted", "4": "error", "5": "error", "6": "accepted",
                                                          "7": "discarded", "8": "accepted", "9": "accepted"}
    plain = X.parse_html(PAGE.decode())
    for k in "123":
        assert (out[k].raw_title, out[k].raw_content) == plain[:2] and len(out[k].raw_links) == 400 and out[k].charset == "utf-8"
    assert out["1"].content_length == len(gzip.compress(PAGE)) and "cut off" in out["4"].body_error
    assert out["6"].detected_type == "application/pdf" and out["6"].raw_content == "" and out["6"].charset == ""
    pages = {r.url[-1]: r for r in X.build_page_data(records).collect()}
    assert set(pages) == set("123689") and pages["6"].type == "text/html" and pages["8"].content == ""
