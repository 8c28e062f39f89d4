"""Spark session helpers: session defaults, shared folder, stored tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(master: str | None = None, app: str = "archivesearch",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Create (or reuse) a session with the settings the engine relies on.

    On a cluster ``master`` is left to spark-submit; tests pass ``local[*]``.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (b.config("spark.sql.adaptive.enabled", "true")
          .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
          .config("spark.sql.adaptive.skewJoin.enabled", "true")
          .config("spark.sql.session.timeZone", "UTC")
          .config("spark.sql.execution.arrow.pyspark.enabled", "true")
          .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
          .config("spark.ui.enabled", "false")
          .config("spark.ui.showConsoleProgress", "false"))
    if not SparkSession.getActiveSession():
        b = b.config("spark.driver.memory", os.environ.get("ARCHIVESEARCH_DRIVER_MEMORY", "8g"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the shared folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins. Only on a local master, where driver and executors are
    one process, is ``fallback`` (or a folder under the working directory) used when it is unset;
    on a cluster that is an error, because executors do not see the driver's disk.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not current:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        current = fallback or os.path.abspath("spark-checkpoints")
        spark.conf.set("spark.checkpoint.dir", current)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return current


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which all executors can reach."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"


#: Spark 4.1: the shuffle files of a job go when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_table(df: DataFrame, path: str, **options: str) -> None:
    """Write ``df`` as Parquet. The rows shuffled for it are not read again, so their files go with the job."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode("overwrite").options(**options).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


#: For tables that grow with the texts: about a quarter less than the default codec.
PACKED = {"compression": "zstd"}


def stored(df: DataFrame, name: str, path: str | None = None, **options: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and go on from the stored rows: lineage
    ends here, later scans read only the columns they use."""
    spark = df.sparkSession
    path = path or shared_path(spark, name)
    write_table(df, path, **options)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes, written as JSON, up to which the rows of a table go to all tasks.
SMALL_BYTES = 32 << 20


def small(table: DataFrame) -> DataFrame:
    """A stored table of a batch, marked for broadcast if its rows are few. Its files say little about that: their size grows with
    their number, and a large table that meets one over the broadcast threshold is shuffled whole. Larger tables are left to Spark's choice."""
    size = table.agg(F.sum(F.octet_length(F.to_json(F.struct(*table.columns))))).first()[0] or 0
    return F.broadcast(table) if size <= SMALL_BYTES else table


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
