"""Identifiers and digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from archivesearch.functions._util import col_of


def page_id(tstamp, url) -> Column:
    """``tstamp/base64(md5(url))``."""
    return F.concat(col_of(tstamp), F.lit("/"), F.base64(F.unhex(F.md5(col_of(url)))))


def payload_digest(payload, algorithm: str = "md5") -> Column:
    """upper-case hex digest of the payload (MD5 by default, SHA-1 as an option)."""
    p = col_of(payload)
    if algorithm == "md5":
        return F.upper(F.md5(p))
    if algorithm == "sha1":
        return F.upper(F.sha1(p))
    raise ValueError(f"unknown digest algorithm {algorithm!r}")


def result_id(tstamp, url) -> Column:
    """result id ``tstamp/url``."""
    return F.concat_ws("/", col_of(tstamp), col_of(url))
