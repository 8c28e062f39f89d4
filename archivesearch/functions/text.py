"""Text scalars: whitespace clean-up, MIME split, tokens and query analysis."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from archivesearch.functions._util import col_of

# A token is a maximal run of letters and digits, compared lower-cased.
TOKEN_RE = r"[\p{L}\p{N}]+"
# Java's String.trim() removes every char <= U+0020; runs of ASCII whitespace collapse to one space.
TRIM_RE = r"^[\x00-\x20]+|[\x00-\x20]+$"
WS_RUN_RE = r"[ \t\n\x0B\f\r]+"
# A phrase is a double-quoted span whose quotes touch a blank or an end of the query.
PHRASE_RE = r'(?:^|\s)"([^"]*)"(?=\s|$)'
PHRASE_STRIP_RE = r'(^|\s)"[^"]*"(?=\s|$)'
# An exclusion is ``-word`` at the start or after a blank, outside phrases.
EXCLUDE_RE = r"(?:^|\s)-(\S+)"
EXCLUDE_STRIP_RE = r"(^|\s)-\S+"
MAX_SERVED_TYPE = 200


def clean_whitespace(s) -> Column:
    """trim control/blank characters at both ends, collapse ASCII whitespace runs."""
    return F.regexp_replace(F.regexp_replace(col_of(s), TRIM_RE, ""), WS_RUN_RE, " ")


def served_type(content_type) -> Column:
    """The served content type, cut at 200 characters."""
    return F.substring(col_of(content_type), 1, MAX_SERVED_TYPE)


def mime_type(content_type) -> Column:
    """F16: MIME type = text before the first ``;``."""
    return F.split_part(col_of(content_type), F.lit(";"), F.lit(1))


def primary_type(content_type) -> Column:
    return F.split_part(mime_type(content_type), F.lit("/"), F.lit(1))


def sub_type(content_type) -> Column:
    return F.split_part(mime_type(content_type), F.lit("/"), F.lit(2))


def tokens(text) -> Column:
    """Lower-cased letter/digit runs of a text, in order (array<string>)."""
    return F.regexp_extract_all(F.lower(col_of(text)), F.lit("(" + TOKEN_RE + ")"), 1)


def query_phrases(q) -> Column:
    """quoted phrases of a query, each as its token array."""
    raw = F.regexp_extract_all(col_of(q), F.lit(PHRASE_RE), 1)
    return F.filter(F.transform(raw, lambda p: tokens(p)), lambda t: F.size(t) > 0)


def _outside_phrases(q) -> Column:
    return F.regexp_replace(col_of(q), PHRASE_STRIP_RE, "$1 ")


def query_excludes(q) -> Column:
    """tokens of the ``-word`` exclusions outside phrases."""
    words = F.regexp_extract_all(_outside_phrases(q), F.lit(EXCLUDE_RE), 1)
    return F.array_distinct(F.flatten(F.transform(words, lambda w: tokens(w))))


def query_terms(q) -> Column:
    """plain terms = tokens outside phrases and exclusions."""
    rest = F.regexp_replace(_outside_phrases(q), EXCLUDE_STRIP_RE, "$1 ")
    return F.array_distinct(tokens(rest))
