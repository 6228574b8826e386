"""Session helpers shared by all operators: shared-folder tables, latest-row selection, table loading."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as the cluster names it in ``spark.checkpoint.dir``.

    Only where that is unset, as in local tests, a temporary folder of this machine is set for the session.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        known = tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


_WRITTEN: list[str] = []


def drop_materialized(spark: SparkSession) -> int:
    """Delete the tables this process has written by ``materialize``; call it when no result built on them is needed any more."""
    n = 0
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        n += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return n


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there and any executor may be lost."""
    path = f"{shared_dir(df.sparkSession)}/lectern-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def latest(df: DataFrame, keys: list[str], columns: list[str], at: str = "ingested_at") -> DataFrame:
    """One row per key: that with the latest ``at`` (nulls lose; equal times: the greatest of the remaining columns).

    A partial aggregate runs before the shuffle, so a record delivered any number of times costs one row per task.
    Rows whose key holds a null are one record per distinct null key, as in SQL grouping.
    """
    rest = [c for c in columns if c not in keys]
    held = F.max(F.struct(F.col(at).alias("__at"), *[F.col(c).alias(f"__{i}") for i, c in enumerate(rest)])).alias("__held")
    return df.groupBy(*keys).agg(held).select(*keys, *[F.col(f"__held.__{i}").alias(c) for i, c in enumerate(rest)])


def exact_mean(column: str) -> Column:
    """Mean to six decimals by a sum of whole millionths: the same in whatever order rows are added."""
    c = F.col(column)
    return F.round(F.sum(F.round(c * 1_000_000).cast("long")) / F.count(c) / 1_000_000, 6)
