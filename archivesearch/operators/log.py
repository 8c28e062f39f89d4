"""Search log sink (S11): one tab-separated line per query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def search_log(queries: DataFrame, results: DataFrame, ip: str = "", agent: str = "",
               duration_ms: int | None = None) -> DataFrame:
    """``ip, agent, request, duration, query JSON, JSON list of result ids`` per query.

    Result ids are gathered per query from the page rows only (bounded by max_items),
    ordered by (rank, group_rank).
    """
    ids = results.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "group_rank", "id"))).alias("r"))
    j = queries.join(ids, "qid", "left")
    request = F.concat(F.lit("/textsearch?q="), F.coalesce(F.url_encode("q"), F.lit("")))
    qjson = F.to_json(F.struct(*[c for c in queries.columns]), {"ignoreNullFields": "true"})
    rjson = F.to_json(F.coalesce(F.transform("r", lambda x: x["id"]), F.array().cast("array<string>")))
    line = F.concat_ws("\t", F.lit(ip), F.lit(agent), request,
                       F.lit("" if duration_ms is None else str(duration_ms)), qjson, rjson)
    return j.select("qid", line.alias("line"))


def write_search_log(log: DataFrame, path: str, mode: str = "append") -> None:
    log.select("line").write.mode(mode).text(path)
