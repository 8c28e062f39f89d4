"""Helpers shared by the operators: stored tables in the cluster's shared folder, safe column choice."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archivesearch.session import ensure_checkpoint_dir


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which all executors can reach."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def reread(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` once as Parquet and go on from the stored rows: lineage ends here, and a
    lost executor costs a re-read instead of the work before it."""
    df.write.parquet(path)
    return reread(df.sparkSession, path, df.schema)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a stored table that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def without(df: DataFrame, taken: list[str]) -> list[str]:
    """Columns of ``df`` whose names (compared without case) a result does not use itself."""
    lower = {name.lower() for name in taken}
    return [c for c in df.columns if c.lower() not in lower]


def col(name: str):
    """A column by its literal name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    names = {c.lower() for c in df.columns}
    while stem.lower() in names:
        stem += "_"
    return stem


def hashed_sample(df: DataFrame, keys: list[str], n: int, total: int | None = None) -> DataFrame:
    """``n`` rows (all, if there are fewer) with the smallest hash of ``keys``. A cut by the hash
    comes first, so that the tasks hand on about ``2 * n`` rows in all, not ``n`` rows each. With a
    ``total`` above the number of rows the cut can leave fewer than ``n``."""
    total = df.count() if total is None else total
    h = F.xxhash64(*[col(k) for k in keys])
    if total > 2 * n:
        df = df.filter(F.pmod(h, F.lit(1 << 31)) < int((1 << 31) * 2 * n / total) + 1)
    return df.orderBy(F.pmod(h, F.lit(1 << 31)), h, *[col(k) for k in keys]).limit(n)
