"""Co-partitioned page and edge tables.

Pages and inverted edges are kept as bucketed tables on the link key ``(surt, time_slice)``, in the same
number of buckets. A new crawl is appended: it writes files of its own into the buckets it
touches and rewrites nothing. Set semantics are restored when edges are read, where the buckets
already bring equal keys together, so anchors, counts, the latest page of a key and the join of
pages with inlinks need no exchange of the stored sides.

A bucket holds whole keys, so a target with very many links would make one bucket large. Keys that
pass ``hot_edges`` edges in a crawl are written to a second table, which is spread by all its columns.
There are at most edges / ``hot_edges`` such keys; only their rows are exchanged.

The bucketing is recorded beside the tables, so a later application opens them as they are.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from archivesearch.functions.timestamps import time_slice
from archivesearch.operators import links as L
from archivesearch.operators.docs import PAGE_ORDER
from archivesearch.session import path_exists, shared_path, stored

KEY = L.EDGE_KEY
EDGE = [*KEY, "from_url", "anchor"]
EDGE_SCHEMA = "surt string, time_slice string, from_url string, anchor string"


class LinkStore:
    """Tables below ``path``; one store has one time-slice policy."""

    def __init__(self, spark: SparkSession, path: str, policy: str, buckets: int, hot_edges: int):
        self.spark, self.path, self.policy, self.buckets, self.hot_edges = spark, path.rstrip("/"), policy, buckets, hot_edges
        self._names = {name: f"linkstore_{name}_{uuid.uuid4().hex}" for name in ("pages", "edges")}
        self._known: set[str] = set()

    @classmethod
    def create(cls, spark: SparkSession, path: str, policy: str = "none", buckets: int = 200, hot_edges: int = 1_000_000) -> "LinkStore":
        store = cls(spark, path, policy, buckets, hot_edges)
        spec = json.dumps({"policy": policy, "buckets": buckets, "hot_edges": hot_edges})
        spark.createDataFrame([(spec,)], "value string").coalesce(1).write.text(f"{store.path}/spec")
        return store

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> "LinkStore":
        spec = json.loads(spark.read.text(f"{path.rstrip('/')}/spec").first()["value"])
        return cls(spark, path, **spec)

    # -------------------------------------------------------------- stored tables

    def _table(self, name: str) -> DataFrame | None:
        """The bucketed table, known to this session's catalog under a name of its own; None before the first rows."""
        place = f"{self.path}/{name}"
        if name not in self._known:
            if not path_exists(self.spark, place):
                return None
            fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.read.parquet(place).schema.fields)
            keys = ", ".join(KEY)
            self.spark.sql(f"CREATE TABLE {self._names[name]} ({fields}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) "
                           f"INTO {self.buckets} BUCKETS LOCATION '{place}'")
            self._known.add(name)
        return self.spark.table(self._names[name])

    def _append(self, name: str, rows: DataFrame) -> None:
        """One exchange by the key, when rows arrive: a task writes whole buckets, one file each."""
        if name not in self._known and path_exists(self.spark, f"{self.path}/{name}"):
            self._table(name)
        (rows.repartition(self.buckets, *KEY).write.bucketBy(self.buckets, *KEY).sortBy(*KEY).mode("append")
         .option("path", f"{self.path}/{name}").saveAsTable(self._names[name]))
        self._known.add(name)

    def _plain(self, name: str, schema: str) -> DataFrame:
        place = f"{self.path}/{name}"
        if not path_exists(self.spark, place):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(place)

    def _hot_keys(self) -> DataFrame | None:
        """Distinct hot keys, or None: plans of a store without any leave them out."""
        if not path_exists(self.spark, f"{self.path}/hot_keys"):
            return None
        return self._plain("hot_keys", "surt string, time_slice string").distinct()

    # -------------------------------------------------------------- writing

    def add_pages(self, pages: DataFrame, surt_col: str = "surt_url") -> None:
        """Append captured pages (columns of the page table) under their link key."""
        keyed = pages.withColumn("surt", F.col(surt_col)).withColumn("time_slice", time_slice("tstamp", self.policy))
        self._append("pages", keyed)

    def add_edges(self, edges: DataFrame) -> None:
        """U4: append the inverted edges of a crawl, ``(from_url, to_url, anchor, tstamp)``."""
        rows = stored(L.invert_links(edges, self.policy).select(*EDGE), "crawl", shared_path(self.spark, "crawl"))
        hot = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > self.hot_edges).select(*KEY)
        hot = stored(hot, "hot", shared_path(self.spark, "hot"))
        if not hot.isEmpty():
            hot.write.mode("append").parquet(f"{self.path}/hot_keys")
        keys = self._hot_keys()
        if keys is None:
            self._append("edges", rows)
            return
        rows.join(keys, KEY, "left_semi").write.mode("append").parquet(f"{self.path}/hot_edges")
        self._append("edges", rows.join(keys, KEY, "left_anti"))

    # -------------------------------------------------------------- reading

    def inlinks(self) -> tuple[DataFrame, DataFrame | None]:
        """Distinct edges of ordinary keys, by buckets, and of hot keys (None without any): a key that became hot later has
        edges in both tables."""
        edges, keys = self._table("edges"), self._hot_keys()
        if edges is None:
            edges = self.spark.createDataFrame([], EDGE_SCHEMA)
        if keys is None:
            return edges.dropDuplicates(EDGE), None
        hot = self._plain("hot_edges", EDGE_SCHEMA).unionByName(edges.join(keys, KEY, "left_semi"))
        return edges.join(keys, KEY, "left_anti").dropDuplicates(EDGE), hot.dropDuplicates(EDGE)

    def all_inlinks(self) -> DataFrame:
        ordinary, hot = self.inlinks()
        return ordinary if hot is None else ordinary.unionByName(hot)

    def pages(self, keep: str = "latest") -> DataFrame:
        """A8 within the buckets: the page of a key with the greatest ``(tstamp, warc_name, warc_offset)``, or all."""
        pages = self._table("pages")
        if pages is None:
            raise ValueError("the store has no pages")
        if keep == "all":
            return pages
        order = [F.desc_nulls_last(c) for c in PAGE_ORDER if c in pages.columns]
        last = pages.withColumn("place", F.row_number().over(Window.partitionBy(*KEY).orderBy(*order)))
        return last.filter("place = 1").drop("place")

    def pages_with_inlinks(self, keep: str = "latest") -> DataFrame:
        """Pages with the anchors and the number of their inlinks."""
        pages = self.pages(keep)
        pages = pages.drop(*[c for c in ("anchor", "inlinks") if c in pages.columns])
        ordinary, hot = self.inlinks()
        out = pages.join(L.inlink_summary(ordinary), KEY, "left")
        if hot is not None:
            few = L.inlink_summary(hot).select(*KEY, F.col("anchor").alias("hot_anchor"), F.col("inlinks").alias("hot_inlinks"))
            out = out.join(few, KEY, "left").withColumns(
                {"anchor": F.coalesce("anchor", "hot_anchor"), "inlinks": F.coalesce("inlinks", "hot_inlinks")}).drop("hot_anchor", "hot_inlinks")
        return out.withColumns({"anchor": F.coalesce("anchor", F.lit("")), "inlinks": F.coalesce("inlinks", F.lit(0))})
