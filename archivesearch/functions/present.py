"""Result presentation: version strings, service links, snippet fallback, JSON."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivesearch.functions._util import col_of

# The separator placed after each highlighted fragment and after a cut content.
ELLIPSIS = '<span class="ellipsis"> ... </span>'
SNIPPET_FALLBACK_CHARS = 500
VERSION_RE = r"^([^/]*)/([^/]*)/(.*)$"

# Default reply fields of a text search (in this order).
DEFAULT_FIELDS = ["title", "originalURL", "mimeType", "tstamp", "digest", "collection", "id",
                  "snippet", "linkToArchive", "linkToNoFrame", "linkToScreenshot",
                  "linkToExtractedText", "linkToMetadata", "linkToOriginalFile"]


@dataclass(frozen=True)
class Endpoints:
    """Service endpoints used to build result links (deployment configuration)."""
    wayback: str = "https://archive.example/wayback"
    noframe: str = "https://archive.example/noFrame/replay"
    screenshot: str = "https://archive.example/screenshot"
    extracted_text: str = "http://localhost:8081/textextracted"
    textsearch: str = "http://localhost:8081/textsearch"


def parse_version(v) -> Column:
    """``collection/timestamp/surt`` -> struct (surt may hold ``/``); malformed -> null."""
    c = col_of(v)
    ok = c.rlike(VERSION_RE)
    return F.when(ok, F.struct(
        F.regexp_extract(c, VERSION_RE, 1).alias("collection"),
        F.regexp_extract(c, VERSION_RE, 2).alias("tstamp"),
        F.regexp_extract(c, VERSION_RE, 3).alias("surt")))


def version_string(v) -> Column:
    c = col_of(v)
    return F.concat_ws("/", c["collection"], c["tstamp"], c["surt"])


def link_columns(url, tstamp, ep: Endpoints = Endpoints(), text_link: bool = True) -> dict[str, Column]:
    """archive, no-frame, screenshot, extracted-text, metadata and original-file links."""
    u, t = col_of(url), col_of(tstamp)
    noframe = F.concat(F.lit(ep.noframe + "/"), t, F.lit("/"), u)
    url_ts = F.concat(u, F.lit("/"), t)
    links = {
        "linkToArchive": F.concat(F.lit(ep.wayback + "/"), t, F.lit("/"), u),
        "linkToNoFrame": noframe,
        "linkToScreenshot": F.concat(F.lit(ep.screenshot + "?url="), F.url_encode(noframe)),
        "linkToExtractedText": (F.concat(F.lit(ep.extracted_text + "?m="), F.url_encode(url_ts))
                                if text_link else F.lit(None).cast("string")),
        "linkToMetadata": F.concat(F.lit(ep.textsearch + "?metadata="), F.url_encode(url_ts)),
        "linkToOriginalFile": F.concat(F.lit(ep.noframe + "/"), t, F.lit("id_/"), u),
    }
    return links


def with_links(df: DataFrame, url: str = "originalURL", tstamp: str = "tstamp",
               ep: Endpoints = Endpoints(), text_link: bool = True) -> DataFrame:
    return df.withColumns(link_columns(url, tstamp, ep, text_link))


def snippet_fallback(content) -> Column:
    """F23 fallback: first 500 characters, with the ellipsis span when cut; ``""`` if empty."""
    c = F.coalesce(col_of(content), F.lit(""))
    return (F.when(F.length(c) <= SNIPPET_FALLBACK_CHARS, c)
            .otherwise(F.concat(F.substring(c, 1, SNIPPET_FALLBACK_CHARS), F.lit(ELLIPSIS))))


def html_escape(s) -> Column:
    """escape ``& < > "`` for the legacy snippet."""
    c = col_of(s)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def select_fields(results: DataFrame, fields: list[str] | None, keys=("qid", "rank", "group_rank"),
                  show_ids: bool = True) -> DataFrame:
    """Project requested reply fields (case-insensitive), keeping the key columns."""
    wanted = fields or DEFAULT_FIELDS
    if not show_ids:
        wanted = [f for f in wanted if f.lower() != "id"]
    by_lower = {c.lower(): c for c in results.columns}
    cols = [k for k in keys if k in results.columns]
    cols += [by_lower[f.lower()] for f in wanted if f.lower() in by_lower and by_lower[f.lower()] not in cols]
    return results.select(*cols)


def to_json_lines(df: DataFrame, column: str = "json") -> DataFrame:
    """one JSON object per row, nulls dropped."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "true"}).alias(column))
