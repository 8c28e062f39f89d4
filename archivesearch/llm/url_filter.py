"""URL filters that hold at a date: a temporal join of captures with dated list entries.

List entries are dated additions and removals. Per entry they become validity intervals
[valid_from, valid_to). A capture is looked up by all keys its URL has (its host, the domains
above it, its path prefixes), and an as-of join takes, for each key and fetch day, the interval
that began last on or before the day; it counts if it has not ended. The strongest active entry
decides: prefix before host before domain, then the longer value, then allow before block.

The as-of join runs on distinct (key, day), entry by entry and year by year: an interval that is open
at the turn of a year begins again there. So a host with a third of all captures costs at most a
year's days in one task; the join of the answers with the captures is left to adaptive
splitting. Path prefixes are made only down to the depth that some entry has.

Values of entries are compared like URLs: hosts in lower case without final dots, paths without empty
segments and final slash. A prefix entry without a path counts as a host entry.

Defined results: a null or unparsable url has no host and no keys, a null time has no active
entry: both are allowed. Of an addition and a removal on one day the addition holds. Repeated
additions change nothing, nor do removals of what is not listed; entries with a null value, day
or action are left out. Repeated captures each get a row. No entries: all are allowed. Extra
columns are carried along; those named like a result column are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from archivesearch.llm.shared import col, free_name, shared_path, stored, without

COLUMNS = ("verdict", "matched_kind", "matched_value", "matched_lists")
KINDS = {"domain": 1, "host": 2, "prefix": 3}
_ENTRY = ("list_name", "action", "kind", "value")


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals ``(list_name, action, kind, value, valid_from, valid_to)`` of the dated
    ``entries(list_name, action, kind, value, event, day)``; ``event`` is add or remove, an open
    interval has a null ``valid_to``."""
    known = F.col("action").isin("allow", "block") & F.col("kind").isin(*KINDS) & F.col("event").isin("add", "remove")
    host = F.regexp_replace(F.lower(F.substring_index("value", "/", 1)), r"\.+$", "")
    steps = F.filter(F.split("value", "/"), lambda s, k: (k > 0) & (s != ""))
    bare = (F.col("kind") != "prefix") | (F.size(steps) == 0)
    rows = entries.filter(known).dropna(subset=["list_name", "value", "day"]).select(
        "list_name", "action", F.when(bare & (F.col("kind") == "prefix"), F.lit("host")).otherwise(F.col("kind")).alias("kind"),
        F.when(bare, host).otherwise(F.concat_ws("/", host, F.array_join(steps, "/"))).alias("value"), "event", "day")
    days = (rows.filter("value <> ''").groupBy(*_ENTRY, "day").agg(F.max(F.col("event") == "add").alias("on")))  # add wins the day
    own = W.partitionBy(*_ENTRY).orderBy("day")
    turns = (days.withColumn("was", F.coalesce(F.lag("on").over(own), F.lit(False))).filter("on <> was"))
    return (turns.withColumn("valid_to", F.lead("day").over(own)).filter("on")
            .select(*_ENTRY, F.col("day").alias("valid_from"), "valid_to"))


def host_of(url):
    """Lower-case host without user, port and final dots; null if there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(authority), r"^.*@", ""), r"\.*(:[0-9]*)?$", "")
    return F.nullif(host, F.lit(""))


def path_of(url):
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def url_keys(host, path, prefix_depth: int):
    """Array of (kind, value): the host, each domain from it upwards, host and path prefixes of
    1 to ``prefix_depth`` segments (values without a final slash)."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(
        F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("value")))
    steps = F.filter(F.split(path, "/"), lambda s: s != "")
    depth = F.least(F.size(steps), F.lit(prefix_depth))
    prefixes = F.transform(
        F.when(depth >= 1, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.lit("prefix").alias("kind"),
                           F.concat(host, F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i), "/")).alias("value")))
    own = F.array(F.struct(F.lit("host").alias("kind"), host.alias("value")))
    return F.when(host.isNotNull(), F.concat(own, domains, prefixes))


def active(needed: DataFrame, valid: DataFrame) -> DataFrame:
    """As-of join: the entries of ``valid`` active for each of the distinct ``needed(kind, value, day)``."""
    asked = needed.join(valid.select(*_ENTRY).distinct(), ["kind", "value"]).select(
        *_ENTRY, F.year("day").alias("year"), "day", F.lit(1).alias("asked"), F.lit(None).cast("struct<f:date,t:date>").alias("at"))
    low, high = needed.agg(F.min(F.year("day")), F.max(F.year("day"))).first()
    first = F.greatest(F.year("valid_from"), F.lit(low))
    last = F.least(F.coalesce(F.year("valid_to"), F.lit(high)), F.lit(high))
    began = (valid.filter(first <= last).withColumn("year", F.explode(F.sequence(first, last)))
             .select(*_ENTRY, "year", F.greatest("valid_from", F.make_date("year", F.lit(1), F.lit(1))).alias("day"), F.lit(0).alias("asked"),
                     F.struct(F.col("valid_from").alias("f"), F.col("valid_to").alias("t")).alias("at")))
    own = W.partitionBy(*_ENTRY, "year").orderBy("day", "asked").rowsBetween(W.unboundedPreceding, W.currentRow)
    latest = asked.unionByName(began).withColumn("at", F.last("at", ignorenulls=True).over(own))
    return (latest.filter("asked = 1 and at is not null and (at.t is null or day < at.t)").select(*_ENTRY, "day"))


def filter_urls(captures: DataFrame, entries: DataFrame, url: str = "url", time: str = "fetched") -> DataFrame:
    """All rows and columns of ``captures`` (but those named as in ``COLUMNS``) with ``verdict``
    (allow, block), the kind and value of the deciding entry and the lists that hold it."""
    spark, carried = captures.sparkSession, without(captures, list(COLUMNS))
    row = free_name(captures, "_capture")
    # Stored, so that both sides of the last join see the same row numbers.
    rows = stored(captures.select(*[col(c) for c in captures.columns], F.monotonically_increasing_id().alias(row)),
                  shared_path(spark, "captures"))
    valid = stored(intervals(entries), shared_path(spark, "validity"))
    depth = valid.filter("kind = 'prefix'").agg(F.max(F.size(F.split("value", "/")) - 1)).first()[0] or 0
    keys = (rows.select(F.col(row).alias("capture"), host_of(col(url)).alias("host"), path_of(col(url)).alias("path"),
                        col(time).cast("date").alias("day")).filter("host is not null and day is not null")
            .select("capture", "day", F.explode(url_keys(F.col("host"), F.col("path"), depth)).alias("k"))
            .select("capture", "day", "k.kind", "k.value"))
    listed = keys.join(valid.select("kind", "value").distinct(), ["kind", "value"], "left_semi")
    answers = (active(listed.select("kind", "value", "day").distinct(), valid)
               .groupBy("kind", "value", "day", "action").agg(F.sort_array(F.collect_set("list_name")).alias("lists")))
    rank = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    strength = F.struct(rank[F.col("kind")].alias("rank"), F.length("value").alias("size"),
                        (F.col("action") == "allow").alias("allow"))
    best = (listed.join(answers, ["kind", "value", "day"]).groupBy("capture")
            .agg(F.max(F.struct(strength.alias("strength"), "kind", "value", "action", "lists")).alias("b")))
    of, found = free_name(rows, "capture"), free_name(rows, "best")
    best = best.select(F.col("capture").alias(of), F.col("b").alias(found))
    return rows.join(best, F.col(row) == F.col(of), "left").select(
        *[col(c) for c in carried], F.coalesce(f"{found}.action", F.lit("allow")).alias("verdict"),
        F.col(f"{found}.kind").alias("matched_kind"), F.col(f"{found}.value").alias("matched_value"),
        F.array_join(f"{found}.lists", ",").alias("matched_lists"))
