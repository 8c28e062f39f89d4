"""14-digit capture-time scalars (F8-F11, F27, A11). Timestamps stay strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from archivesearch.functions._util import col_of

# Fixed values (must equal the reference's):
DEFAULT_TIMESTAMP = "19910101000000"
MIN_YEAR, MAX_YEAR = 1991, 9999
# time-slice policy -> number of leading digits of the 14-digit timestamp
TIME_SLICES = {"none": 0, "year": 4, "monthly": 6, "daily": 8}


def canonical_timestamp(t) -> Column:
    """F8: any string -> valid-looking ``YYYYMMDDhhmmss``.

    Non-digits give the default; longer is cut at 14; shorter is completed from the
    default; year outside 1991..9999 -> 1991, month -> 01, day (only > 31) -> 01,
    hour/minute/second out of range -> 00.
    """
    c = col_of(t)
    r = F.when(~c.rlike(r"^[0-9]*$"), F.lit(DEFAULT_TIMESTAMP)).otherwise(
        F.concat(F.substring(c, 1, 14),
                 F.substring(F.lit(DEFAULT_TIMESTAMP), F.length(c) + 1, 14)))

    def part(pos: int, n: int) -> Column:
        return F.substring(r, pos, n).cast("int")

    year, month, day = part(1, 4), part(5, 2), part(7, 2)
    hour, minute, second = part(9, 2), part(11, 2), part(13, 2)
    year = F.when((year < MIN_YEAR) | (year > MAX_YEAR), F.lit(MIN_YEAR)).otherwise(year)
    month = F.when((month < 1) | (month > 12), F.lit(1)).otherwise(month)
    day = F.when((day < 1) | (day > 31), F.lit(1)).otherwise(day)
    hour = F.when(hour > 23, F.lit(0)).otherwise(hour)
    minute = F.when(minute > 59, F.lit(0)).otherwise(minute)
    second = F.when(second > 59, F.lit(0)).otherwise(second)

    def pad(x: Column, n: int) -> Column:
        return F.lpad(x.cast("string"), n, "0")

    return F.concat(pad(year, 4), pad(month, 2), pad(day, 2), pad(hour, 2), pad(minute, 2),
                    pad(second, 2))


def solr_date(t) -> Column:
    """``YYYYMMDDhhmmss`` -> ``YYYY-MM-DDThh:mm:ssZ`` (after F8)."""
    s = canonical_timestamp(t)
    return F.concat(F.substring(s, 1, 4), F.lit("-"), F.substring(s, 5, 2), F.lit("-"),
                    F.substring(s, 7, 2), F.lit("T"), F.substring(s, 9, 2), F.lit(":"),
                    F.substring(s, 11, 2), F.lit(":"), F.substring(s, 13, 2), F.lit("Z"))


def bound_padding(t) -> Column:
    """a query bound is cut at 14 characters or right-padded with ``0``."""
    return F.rpad(F.substring(col_of(t), 1, 14), 14, "0")


def digits_only(d) -> Column:
    """record date -> its digits."""
    return F.regexp_replace(col_of(d), "[^0-9]", "")


def legacy_timestamp(t) -> Column:
    """legacy validation works on the first 14 characters."""
    return canonical_timestamp(F.substring(col_of(t), 1, 14))


def ts14(ts) -> Column:
    """A Spark timestamp column rendered as 14 digits."""
    return F.date_format(col_of(ts), "yyyyMMddHHmmss")


def slice_length(policy: str) -> int:
    """Validate a time-slice policy; unknown policies are an error."""
    try:
        return TIME_SLICES[policy]
    except KeyError:
        raise ValueError(f"invalid time slice policy: {policy!r}; "
                         f"expected one of {sorted(TIME_SLICES)}") from None


def time_slice(tstamp, policy: str) -> Column:
    """Leading digits of the timestamp that key the link graph (``''`` for none)."""
    return F.substring(col_of(tstamp), 1, slice_length(policy))
