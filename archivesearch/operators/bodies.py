"""Payload bytes to text: transfer and content codings, type detection, character sets.

``decode_body`` undoes the codings of an HTTP answer as a chain of streams of bounded size.
``detect_type`` looks at the first bytes and decides which parser a page gets where the served type is
missing or wrong. ``charset_of`` finds the character set of a page. All work on one payload; ``extract``
calls them inside its one pass over the accepted records.
"""

from __future__ import annotations

import codecs
import re
import zlib
from collections.abc import Iterator

CHUNK = 1 << 16
MAX_BODY = 1 << 28  # bytes of a decoded body


class BodyError(ValueError):
    """The body cannot be decoded."""


# ------------------------------------------------------------------ codings

# Names of codings; those that servers send though nothing is coded.
GZIP, DEFLATE, BROTLI = ("gzip", "x-gzip"), ("deflate", "x-deflate"), ("br",)
NO_CODING = ("", "identity", "none", "binary", "7bit", "8bit", "utf-8", "utf8", "iso-8859-1")
_CHUNK_SIZE_RE = re.compile(rb"[ \t]*([0-9A-Fa-f]{1,16})[ \t]*(;[^\n]*)?\r?\n")


def codings(header: str | None) -> list[str]:
    """Codings of a header in the order they were applied."""
    names = [c.strip().lower() for c in (header or "").split(",")]
    return [c for c in names if c not in NO_CODING]


def _pieces(data: bytes) -> Iterator[bytes]:
    for at in range(0, len(data), CHUNK):
        yield data[at:at + CHUNK]


def _begin(parts: Iterator[bytes], size: int) -> tuple[bytes, Iterator[bytes]]:
    """The first ``size`` bytes (or all), and the whole stream again."""
    held = b""
    for part in parts:
        held += part
        if len(held) >= size:
            break

    def whole():
        if held:
            yield held
        yield from parts

    return held[:size], whole()


def dechunk(parts: Iterator[bytes]) -> Iterator[bytes]:
    """Without the framing of chunked transfer. A body that does not begin with a chunk size was stored without framing."""
    head, parts = _begin(parts, 64)
    if head and not _CHUNK_SIZE_RE.match(head):
        yield from parts
        return
    held = b""
    left = None  # bytes still to come of the chunk; None: a size comes next
    for part in parts:
        held += part
        while held:
            if left is None:
                if held[:2] in (b"\r\n", b"\r"):
                    if len(held) < 2:
                        break
                    held = held[2:]
                size = _CHUNK_SIZE_RE.match(held)
                if not size:
                    if len(held) > 4096 or b"\n" in held:
                        raise BodyError("malformed chunk size")
                    break
                left, held = int(size[1], 16), held[size.end():]
                if left == 0:
                    return  # trailers are no body
            out, held = held[:left], held[left:]
            left -= len(out)
            if out:
                yield out
            if left == 0:
                left = None
    if left is not None or held.strip():
        raise BodyError("the body ends within a chunk")


def inflate(parts: Iterator[bytes], coding: str) -> Iterator[bytes]:
    """Decompressed gzip or deflate, with or without the zlib wrapper. What does not begin like its
    coding was stored decompressed."""
    head, parts = _begin(parts, 64)
    if coding in GZIP:
        if not head.startswith(b"\x1f\x8b"):
            yield from parts
            return
        bits = 31
    else:
        wrapped = len(head) >= 2 and head[0] & 15 == 8 and (head[0] << 8 | head[1]) % 31 == 0
        bits = 15 if wrapped else -15
        if not wrapped:
            try:
                zlib.decompressobj(bits).decompress(head, CHUNK)
            except zlib.error:
                if any(b < 9 for b in head):
                    raise BodyError("the body is not deflated") from None
                yield from parts
                return
    expand = zlib.decompressobj(bits)
    try:
        for part in parts:
            while part:
                if expand.eof:  # gzip members follow each other; other bytes behind the end are let be
                    if bits != 31 or not part.startswith(b"\x1f\x8b"):
                        return
                    expand = zlib.decompressobj(bits)
                yield expand.decompress(part, 16 * CHUNK)
                while expand.unconsumed_tail:
                    yield expand.decompress(expand.unconsumed_tail, 16 * CHUNK)
                part = expand.unused_data
    except zlib.error as e:
        raise BodyError(f"damaged {coding} body: {e}") from None
    if head and not expand.eof:
        raise BodyError(f"the {coding} body is cut off")


def _unbrotli(parts: Iterator[bytes]) -> Iterator[bytes]:
    try:
        import brotli
    except ImportError:
        raise BodyError("no decoder for br") from None
    expand = brotli.Decompressor()
    try:
        for part in parts:
            yield expand.process(part)
    except brotli.error as e:
        raise BodyError(f"damaged br body: {e}") from None
    if not expand.is_finished():
        raise BodyError("the br body is cut off")


def decode_body(payload: bytes, transfer: str | None = None, content: str | None = None, max_body: int = MAX_BODY) -> bytes:
    """The body without its transfer and content codings, last applied first. Raises ``BodyError`` for unknown codings, damage,
    and bodies over ``max_body`` bytes; no stage holds more than a few chunks."""
    todo = [*reversed(codings(transfer)), *reversed(codings(content))]
    if not todo:
        return payload
    parts: Iterator[bytes] = _pieces(payload)
    for name in todo:
        if name == "chunked":
            parts = dechunk(parts)
        elif name in GZIP or name in DEFLATE:
            parts = inflate(parts, name)
        elif name in BROTLI:
            parts = _unbrotli(parts)
        else:
            raise BodyError(f"unknown coding {name[:40]!r}")
    out, size = [], 0
    for part in parts:
        size += len(part)
        if size > max_body:
            raise BodyError(f"the body is over {max_body} bytes")
        out.append(part)
    return b"".join(out)


# ------------------------------------------------------------------ types

# First bytes of formats; element names that begin an HTML page.
MAGIC = ((b"%PDF-", "application/pdf"), (b"%!PS", "application/postscript"), (b"{\\rtf", "application/rtf"),
         (b"PK\x03\x04", "application/zip"), (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "application/x-ole-storage"),
         (b"\x1f\x8b\x08", "application/gzip"), (b"BZh", "application/x-bzip2"), (b"7z\xbc\xaf\x27\x1c", "application/x-7z-compressed"),
         (b"\x89PNG\r\n\x1a\n", "image/png"), (b"GIF87a", "image/gif"), (b"GIF89a", "image/gif"), (b"\xff\xd8\xff", "image/jpeg"),
         (b"OggS", "application/ogg"), (b"ID3", "audio/mpeg"), (b"\x00\x00\x01\x00", "image/x-icon"), (b"wOFF", "font/woff"),
         (b"\xca\xfe\xba\xbe", "application/java-vm"), (b"CWS", "application/x-shockwave-flash"), (b"FWS", "application/x-shockwave-flash"))
HTML_START = ("html", "head", "body", "title", "script", "style", "table", "iframe", "meta", "link", "h1", "h2", "h3", "div", "font",
              "center", "frameset", "br", "p", "a", "b", "ul", "img", "form", "span", "base")
_HTML_RE = re.compile(rb"<(?:!doctype\s+html|(?:" + "|".join(HTML_START).encode() + rb")(?=[\s>/]))", re.I)
_LEAD_RE = re.compile(rb"(?:\s+|<!--.*?-->)*", re.S)
_XML_RE = re.compile(rb"<\?xml\b")
_ROOT_RE = re.compile(rb"(?:<\?.*?\?>|<!--.*?-->|<!doctype[^>]*>|\s+)*<([A-Za-z][\w.:-]*)", re.S | re.I)
SNIFF_BYTES = 4096
_GENERIC = ("", "text/plain", "application/octet-stream", "application/unknown", "application/x-unknown", "unknown/unknown", "*/*",
            "application/force-download", "text")


def sniffed_type(body: bytes) -> str | None:
    """The type that the first bytes show; None if they show none: ``text/plain`` if they can be text."""
    head = body[:SNIFF_BYTES]
    for mark, kind in MAGIC:
        if head.startswith(mark):
            return kind
    if head[:4] == b"RIFF" and head[8:12] == b"WEBP":
        return "image/webp"
    if head[4:8] == b"ftyp":
        return "video/mp4"
    for bom, charset in BOMS:
        if head.startswith(bom):
            head = head.decode(charset, "ignore").removeprefix("\ufeff").encode()
            break
    lead = _LEAD_RE.match(head).end()
    if _HTML_RE.match(head, lead):
        return "text/html"
    if _XML_RE.match(head, lead):
        root = _ROOT_RE.match(head, lead)
        return "application/xhtml+xml" if root and root[1].lower() == b"html" else "application/xml"
    if not head:
        return None
    controls = sum(b < 9 or 13 < b < 27 or 27 < b < 32 for b in head)
    return "text/plain" if controls == 0 else "application/octet-stream"


def detect_type(body: bytes, served: str | None) -> str:
    """The type that decides the parser. Marks of binary formats win over the served type, markup wins over generic types and over
    document types whose own marks are absent; what shows nothing stays as served."""
    kind = (served or "").split(";", 1)[0].strip().lower()
    found = sniffed_type(body)
    if found is None or found == kind:
        return kind or "text/plain"
    if found in ("text/html", "application/xhtml+xml"):
        is_text = kind.startswith("text/") or "xml" in kind or kind in ("application/javascript", "application/json")
        return found if kind in _GENERIC or not is_text else kind
    if found == "text/plain":
        return found if kind in _GENERIC else kind
    if found == "application/xml":
        return found if kind in _GENERIC else kind
    if found == "application/octet-stream":  # control characters: text in UTF-16 without a mark, or no text
        return kind if kind and kind not in _GENERIC else found
    if found in ("application/zip", "application/x-ole-storage") and kind.startswith("application/") and kind not in _GENERIC:
        return kind  # containers of office documents
    return found


# ------------------------------------------------------------------ character sets

# Byte order marks; names that mean another set on the web; letters that the languages of a set use most.
BOMS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
WEB_NAMES = {"iso-8859-1": "windows-1252", "iso8859-1": "windows-1252", "latin1": "windows-1252", "latin-1": "windows-1252",
             "us-ascii": "windows-1252", "ascii": "windows-1252", "iso-8859-9": "windows-1254", "tis-620": "windows-874",
             "utf8": "utf-8", "unicode": "utf-16", "x-sjis": "shift_jis", "gb2312": "gb18030", "gbk": "gb18030",
             "ks_c_5601-1987": "euc-kr", "windows-31j": "shift_jis", "x-mac-roman": "mac-roman"}
FREQUENT = {"windows-1252": "éáãçóíêàèüöäñôúõßâîùåæø", "windows-1250": "łąęśżźćńóčšžřůěáíéýőűöüä", "windows-1254": "ıışğçöüİŞĞ",
            "windows-1251": "оеаинтсрвлкмд", "koi8-r": "оеаинтсрвлкмд", "iso-8859-5": "оеаинтсрвлкмд",
            "windows-1253": "αοιετσνηυρπκμςά", "windows-1255": "יוהלאתרבשםמנ", "windows-1256": "اليمنوتربةعد"}
LATIN_SETS = ("windows-1252", "windows-1250", "windows-1254")
PRESCAN_BYTES = 4096
SCORED_BYTES = 1 << 16
_META_RE = re.compile(rb"""<meta\b[^>]*?\bcharset\s*=\s*["']?\s*([A-Za-z0-9_:.()+-]+)""", re.I)
_XML_ENCODING_RE = re.compile(rb"""^\s*<\?xml\b[^>]*?\bencoding\s*=\s*["']([A-Za-z0-9_.-]+)""", re.I)
_HIGH_RUN_RE = re.compile(rb"[\x00-\x7f]?[\x80-\xff]+[\x00-\x7f]?")


def known_charset(name: str | None) -> str | None:
    """The set that a declared name stands for on the web; None if there is none of that name."""
    name = (name or "").strip().strip("\"'").lower()
    name = WEB_NAMES.get(name, name)
    try:
        return name if name and codecs.lookup(name) and "".encode(name) is not None else None
    except (LookupError, TypeError, UnicodeError):
        return None


def prescanned_charset(body: bytes) -> str | None:
    """The set named by a meta element or XML declaration near the beginning."""
    head = body[:PRESCAN_BYTES]
    found = _XML_ENCODING_RE.search(head) or _META_RE.search(head)
    name = known_charset(found[1].decode("ascii")) if found else None
    return "utf-8" if name and name.startswith("utf-16") else name  # what could be read was not UTF-16


def _decodes(body: bytes, charset: str) -> bool:
    try:
        body.decode(charset)
    except UnicodeDecodeError as e:
        # A character cut at the end is no reason against a set.
        return e.end >= len(body) and e.reason in ("unexpected end of data", "truncated data", "incomplete multibyte sequence")
    return True


def set_score(runs: list[bytes], charset: str) -> float:
    """How much the pairs of neighbouring bytes look like writing in ``charset``. Languages in Latin letters have single
    letters beyond ASCII among others; in other scripts they stand side by side. Within a word small letters do not turn into
    capitals, and words hold no signs."""
    latin, frequent, score, n = charset in LATIN_SETS, set(FREQUENT[charset]), 0.0, 0
    for run in runs:
        text = run.decode(charset, "replace")
        for a, b in zip(text, text[1:]):
            if a.isascii() and b.isascii():
                continue
            n += 1
            if a == "\ufffd" or b == "\ufffd":
                score -= 3
            elif not (a.isalpha() and b.isalpha()):
                sign = (not a.isascii() and not a.isalpha(), not b.isascii() and not b.isalpha())
                score -= any(sign) and (a.isalpha() or b.isalpha())
            elif a.islower() and b.isupper():
                score -= 2
            elif latin != (a.isascii() or b.isascii()):
                score -= 1
            else:
                score += 1 if b.islower() or not b.isupper() else 0.3
        high = [c for c in text if not c.isascii()]
        n += len(high)
        score += sum(c.lower() in frequent for c in high) - 0.5 * sum(c.isalpha() and c.lower() not in frequent for c in high)
    return score / max(1, n)


def guessed_charset(body: bytes) -> str:
    """The single-byte set that scores best."""
    runs = _HIGH_RUN_RE.findall(body[:SCORED_BYTES]) or _HIGH_RUN_RE.findall(body)[:4096]
    best = max(FREQUENT, key=lambda charset: set_score(runs, charset))
    return best if runs else "utf-8"


def charset_of(body: bytes, declared: str | None = None) -> str:
    """BOM; valid UTF-8 that is not plain ASCII; the declared sets (header, then page), if all bytes decode; the best guess."""
    for bom, name in BOMS:
        if body.startswith(bom):
            return name
    header, page = known_charset(declared), prescanned_charset(body)
    if _decodes(body, "utf-8"):
        wide = next((c for c in (header, page) if c and c.startswith("utf-16") and _decodes(body, c) and b"\0" in body[:64]), None)
        return wide or "utf-8"
    for name in (header, page):
        if name and _decodes(body, name):
            return name
    return guessed_charset(body)


def body_text(body: bytes, declared: str | None = None) -> tuple[str, str]:
    """The text of a body and the set it was read in."""
    charset = charset_of(body, declared)
    return body.decode(charset, "replace").removeprefix("\ufeff"), charset
