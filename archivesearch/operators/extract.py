"""Record filtering and page extraction.

Native filters decide each record's disposition first, so only accepted payloads reach Python
(``mapInPandas``, Arrow batches), which undoes the codings of the body, finds its type and character set
(``bodies``) and parses it. Everything after the parser (URL canonicalisation, link resolution,
whitespace clean-up, digests) is native again. A body that cannot be decoded makes its record an error.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from html.parser import HTMLParser
from operator import or_

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as TT

from archivesearch.functions import hashes as H
from archivesearch.functions import text as T
from archivesearch.functions import urls as U
from archivesearch.functions._util import col_of
from archivesearch.functions.timestamps import digits_only
from archivesearch.operators import bodies as B


@dataclass(frozen=True)
class ExtractConfig:
    """Record acceptance rules (S10). Fixed defaults equal the reference's configuration."""
    record_types: tuple[str, ...] = ("response", "revisit")
    status_prefixes: tuple[str, ...] = ("2",)
    primary_types: tuple[str, ...] = ("text", "application")
    excluded_subtypes: tuple[str, ...] = ("xml", "css", "javascript", "x-javascript", "json")
    index_all: bool = False         # P24: any content type (unparsed types keep metadata only)
    index_redirects: bool = False   # P24: 30x records too
    digest: str = "md5"
    parsers: dict = field(default_factory=dict)  # {mime: fn(str) -> (title, text, [(href, text)])}, by MIME type
    max_body: int = B.MAX_BODY      # bytes of a decoded body; larger ones are errors


def record_type_ok(record_type, cfg: ExtractConfig = ExtractConfig()) -> Column:
    """Records without a type (ARC) pass; WARC types must be listed."""
    c = col_of(record_type)
    return c.isNull() | c.isin(*cfg.record_types)


def status_ok(status, cfg: ExtractConfig = ExtractConfig()) -> Column:
    """The status string starts with one of the configured prefixes."""
    c = col_of(status)
    prefixes = (*cfg.status_prefixes, *(("30",) if cfg.index_redirects else ()))
    return reduce(or_, [c.startswith(p) for p in prefixes])


def mime_ok(content_type, cfg: ExtractConfig = ExtractConfig()) -> Column:
    """Primary type included (ignoring case), sub-type before ``;`` not excluded."""
    c = col_of(content_type)
    if cfg.index_all:
        return c.isNotNull()
    primary = F.lower(F.split_part(c, F.lit("/"), F.lit(1)))
    sub = F.lower(F.split_part(F.split_part(c, F.lit("/"), F.lit(2)), F.lit(";"), F.lit(1)))
    return primary.isin(*cfg.primary_types) & ~sub.isin(*cfg.excluded_subtypes)


def mime_parse_fails(content_type) -> Column:
    """A missing content type, or one with nothing after ``/``, makes the reference throw."""
    c = col_of(content_type)
    return c.isNull() | ~c.rlike("/.*[^/]")


def disposition(df: DataFrame, cfg: ExtractConfig = ExtractConfig(), url: str = "url",
                record_type: str = "record_type", status: str = "status",
                content_type: str = "content_type") -> Column:
    """P5: ``accepted`` / ``discarded`` / ``error`` per record, in the reference's order; a record
    that could not be read (column ``error``) is an error whatever else it has."""
    web = F.col(url).rlike(U.WEB_RE)  # the canonical URL begins with http
    unread = F.col("error").isNotNull() if "error" in df.columns else F.lit(False)
    return (F.when(unread, F.lit("error"))
            .when(~record_type_ok(record_type, cfg), F.lit("discarded"))
            .when(F.col(url).isNull(), F.lit("discarded"))
            .when(~web, F.lit("error"))
            .when(F.col(status).isNull(), F.lit("error"))
            .when(~status_ok(status, cfg), F.lit("discarded"))
            .when(mime_parse_fails(content_type), F.lit("error"))
            .when(mime_ok(content_type, cfg), F.lit("accepted"))
            .otherwise(F.lit("discarded")))


def with_disposition(df: DataFrame, cfg: ExtractConfig = ExtractConfig(), **cols) -> DataFrame:
    return df.withColumn("disposition", disposition(df, cfg, **cols))


def disposition_counts(records: DataFrame, cfg: ExtractConfig = ExtractConfig()) -> DataFrame:
    """A4: job counters as a table (records seen per disposition); partial aggregation."""
    return (with_disposition(records, cfg).groupBy("disposition")
            .agg(F.count(F.lit(1)).alias("records")))


# ---------------------------------------------------------------- HTML extraction

# Elements whose text is skipped, link-bearing elements and their attribute.
SKIP_TEXT = {"script", "style", "noscript", "template"}
LINK_ATTRS = {"a": "href", "area": "href", "link": "href", "iframe": "src", "img": "src",
              "script": "src", "frame": "src", "embed": "src"}
BLOCK_TAGS = {"p", "div", "br", "li", "ul", "ol", "tr", "td", "th", "table", "h1", "h2", "h3",
              "h4", "h5", "h6", "article", "section", "nav", "header", "footer", "aside",
              "blockquote", "pre", "form", "dl", "dt", "dd", "hr", "title", "main", "figure"}


class _PageParser(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title: list[str] = []
        self.body: list[str] = []
        self.links: list[tuple[str, str]] = []
        self._skip = 0
        self._in_title = False
        self._in_head = False
        self._anchor: list | None = None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in SKIP_TEXT:
            self._skip += 1
        if tag == "title":
            self._in_title = True
        if tag == "head":
            self._in_head = True
        if tag == "body":
            self._in_head = False
        if tag in BLOCK_TAGS:
            self.body.append("\n")
        attr = LINK_ATTRS.get(tag)
        if attr and a.get(attr):
            if tag == "a":
                self._anchor = [a[attr], []]
                self.links.append(None)  # placeholder keeps document order
                self._anchor.append(len(self.links) - 1)
            else:
                self.links.append((a[attr], a.get("alt") or "" if tag == "img" else ""))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in SKIP_TEXT:
            self._skip -= 1

    def handle_endtag(self, tag):
        if tag in SKIP_TEXT and self._skip:
            self._skip -= 1
        if tag == "title":
            self._in_title = False
        if tag == "head":
            self._in_head = False
        if tag in BLOCK_TAGS:
            self.body.append("\n")
        if tag == "a" and self._anchor is not None:
            href, parts, idx = self._anchor
            self.links[idx] = (href, "".join(parts))
            self._anchor = None

    def handle_data(self, data):
        if self._in_title:
            self.title.append(data)
            return
        if self._skip or self._in_head:
            return
        self.body.append(data)
        if self._anchor is not None:
            self._anchor[1].append(data)

    def result(self):
        if self._anchor is not None:
            href, parts, idx = self._anchor
            self.links[idx] = (href, "".join(parts))
        links = [x for x in self.links if x is not None]
        return "".join(self.title), "".join(self.body), links


def parse_html(doc: str | None) -> tuple[str | None, str, list[tuple[str, str]]]:
    """Title (None when absent), body text and raw ``(href, text)`` links of one HTML page."""
    if not doc:
        return None, "", []
    p = _PageParser()
    try:
        p.feed(doc)
        p.close()
    except Exception:  # malformed markup: keep what was parsed
        pass
    title, body, links = p.result()
    has_title = "<title" in doc.lower()
    return (title if has_title else None), body, links


def declared_charset(content_type: str | None) -> str | None:
    """Charset parameter of a content type."""
    found = re.search(r"(?i)charset=[\"']?([^;\s\"']+)", content_type or "")
    return found.group(1) if found else None


def decode_payload(payload: bytes | None, charset: str | None) -> str:
    """The text of a payload without codings; see ``bodies.charset_of``."""
    return "" if payload is None else B.body_text(payload, charset)[0]


EXTRACTED_FIELDS = [
    TT.StructField("raw_title", TT.StringType()),
    TT.StructField("raw_content", TT.StringType()),
    TT.StructField("raw_links", TT.ArrayType(TT.StructType([
        TT.StructField("href", TT.StringType()), TT.StructField("text", TT.StringType())]))),
    TT.StructField("charset", TT.StringType()),
    TT.StructField("detected_type", TT.StringType()),
    TT.StructField("body_error", TT.StringType()),
]


def _extracted(doc, mime: str | None, transfer: str | None, content: str | None, cfg: ExtractConfig) -> tuple:
    """Values of ``EXTRACTED_FIELDS`` of one document, given as text or as payload bytes."""
    served = (mime or "").lower()
    charset = declared_charset(mime)
    try:
        if isinstance(doc, (bytes, bytearray)):
            body = B.decode_body(bytes(doc), transfer, content, cfg.max_body)
            kind = B.detect_type(body, served)
            if kind == "application/gzip" and served.startswith(("text/", "application/xhtml")):
                body = B.decode_body(body, None, "gzip", cfg.max_body)  # compressed, and no header says so
                kind = B.detect_type(body, served)
        else:
            body = None
            kind = B.detect_type((doc or "")[:B.SNIFF_BYTES].encode("utf-8", "surrogatepass"), served)
        own = cfg.parsers.get(kind) or cfg.parsers.get(served.split(";", 1)[0].strip())
        text = doc or ""
        if body is not None and (own or kind.startswith("text/") or kind == "application/xhtml+xml"):
            text, charset = B.body_text(body, charset)
        elif body is not None:
            text, charset = "", None
    except B.BodyError as e:
        return None, None, [], None, None, str(e)
    if own:
        title, content_text, links = own(text)
    elif kind in ("text/html", "application/xhtml+xml") or "html" in kind:
        title, content_text, links = parse_html(text)
    elif kind.startswith("text/"):
        title, content_text, links = None, text, []      # E3: plain text as is
    else:                                                # unknown type: metadata only
        title, content_text, links, charset = None, "", [], None
    return title, content_text, [{"href": h, "text": x} for h, x in links], (charset or "").lower(), kind, None


def _extract_batches(batches, text_col: str, type_col: str, cfg: ExtractConfig, keep: list[str]):
    for pdf in batches:
        none = [None] * len(pdf)
        transfer, content = (pdf[c] if c in pdf.columns else none for c in ("transfer_encoding", "content_encoding"))
        found = [_extracted(doc, mime, t, c, cfg) for doc, mime, t, c in zip(pdf[text_col], pdf[type_col], transfer, content)]
        out = pdf[keep].copy()
        for n, f in enumerate(EXTRACTED_FIELDS):
            out[f.name] = [r[n] for r in found]
        yield out


def extract_pages(df: DataFrame, text_col: str = "html", type_col: str = "type",
                  cfg: ExtractConfig = ExtractConfig()) -> DataFrame:
    """Title, body text and outlinks of documents, given as text or as payload bytes (decoded here record by record,
    so one malformed body cannot stop the job), the character set and type they were read in, or what is wrong
    (``body_error``). Columns ``transfer_encoding`` and ``content_encoding`` name the codings of payloads.

    A narrow per-partition stage: every column except the text passes through, and the
    extracted columns are appended (no shuffle, no join back).
    """
    keep = [c for c in df.columns if c != text_col]
    schema = TT.StructType([f for f in df.schema.fields if f.name != text_col] + EXTRACTED_FIELDS)
    return df.mapInPandas(
        lambda it: _extract_batches(it, text_col, type_col, cfg, keep), schema)


def extract_records(records: DataFrame, cfg: ExtractConfig = ExtractConfig(), collection: str | None = None,
                    only_accepted: bool = False) -> DataFrame:
    """P1-P5 and E1-E4 in one pass: every record with its final ``disposition`` (a body that cannot be decoded is an error)
    and, if accepted, its extracted columns. ``only_accepted`` leaves refused records out before Python."""
    r = records
    if "tstamp" not in r.columns:
        r = r.withColumn("tstamp", digits_only("record_date"))
    if "collection" not in r.columns:
        r = r.withColumn("collection", F.lit(collection or ""))
    body = "payload" if "payload" in r.columns else "html"
    r = with_disposition(r, cfg)
    accepted = F.col("disposition") == "accepted"
    if only_accepted:
        r = r.filter(accepted)
    coded = {f"{name}_encoding": F.col("headers")[f"{name}-encoding"] if "headers" in r.columns else F.lit(None).cast("string")
             for name in ("transfer", "content")}
    # Only what the page needs goes through Python, the body once, and of accepted records only.
    prepared = r.select(
        "disposition", "tstamp", "collection", "warc_name", "warc_offset", F.when(accepted, F.col(body)).alias(body),
        U.canonical_url("url").alias("c_url"),
        T.served_type("content_type").alias("type_full"),
        F.octet_length(body).cast("long").alias("content_length"),
        H.payload_digest(F.col(body), cfg.digest).alias("digest"),
        *[c.alias(name) for name, c in coded.items()])
    out = extract_pages(prepared, text_col=body, type_col="type_full", cfg=cfg)
    return out.withColumn("disposition", F.when(F.col("body_error").isNotNull(), F.lit("error")).otherwise(F.col("disposition")))


def record_counters(extracted: DataFrame, observation: Observation) -> DataFrame:
    """A4: ``extracted`` itself; when it is written, ``observation`` has the counts of records by disposition and of archives that
    could not be opened, taken in the same pass."""
    count = lambda what: F.count(F.when(what, 1))
    return extracted.observe(
        observation, F.count(F.lit(1)).alias("records"),
        *[count(F.col("disposition") == name).alias(name) for name in ("accepted", "discarded", "error")],
        count(F.col("warc_offset").isNull()).alias("archive_errors"))


def build_page_data(records: DataFrame, cfg: ExtractConfig = ExtractConfig(),
                    collection: str | None = None, observation: Observation | None = None) -> DataFrame:
    """E5: records -> page table (``PageData`` columns + ``out_links``).

    Input columns: ``url, record_date|tstamp, record_type, status, content_type, html|payload,
    warc_name, warc_offset`` and optionally ``collection`` and ``headers``. The digest is that of the
    payload as stored; ``type`` is the served type, ``detected_type`` the one that chose the parser, ``encoding`` the
    character set it was read in. With ``observation`` all records are counted on the way.
    """
    ex = extract_records(records, cfg, collection, only_accepted=observation is None)
    if observation is not None:
        ex = record_counters(ex, observation)
    ex = ex.filter("disposition = 'accepted'")
    content = T.clean_whitespace("raw_content")
    out_links = F.transform(
        "raw_links",
        lambda l: F.struct(U.canonical_url(U.resolve_link(F.col("c_url"), l["href"])).alias("to_url"),
                           F.coalesce(T.clean_whitespace(l["text"]), F.lit("")).alias("anchor")))
    return ex.select(
        H.page_id("tstamp", "c_url").alias("id"),
        F.coalesce(F.col("raw_title"), F.lit("")).alias("title"),
        F.lit("").alias("anchor"),
        "collection",
        content.alias("content"),
        "content_length",
        "digest",
        "tstamp",
        U.url_host("c_url").alias("site"),
        F.col("c_url").alias("url"),
        U.surt("c_url").alias("surt_url"),
        F.lit(0).alias("inlinks"),
        F.size("raw_links").alias("outlinks"),
        T.mime_type("type_full").alias("type"),
        T.primary_type("type_full").alias("primary_type"),
        T.sub_type("type_full").alias("sub_type"),
        F.coalesce("charset", F.lit("")).alias("encoding"),
        "warc_name",
        F.col("warc_offset").cast("long").alias("warc_offset"),
        out_links.alias("out_links"),
        "detected_type",
    )
