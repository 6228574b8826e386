"""Evaluation metrics as aggregates: chunk quality, faithfulness, coverage, latency, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def size_stats(df: DataFrame, by: str, size: Column, least: float, most: float) -> DataFrame:
    """Count, mean, sample deviation (0 for one row), extremes, 5th and 95th percentile (interpolated), share over and under the limits."""
    x = df.withColumn("__s", size.cast("double"))
    return x.groupBy(by).agg(
        F.count("__s").alias("n"), F.round(F.avg("__s"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("__s"), F.lit(0.0)), 6).alias("std"), F.min("__s").alias("least"), F.max("__s").alias("most"),
        F.round(F.percentile("__s", F.lit(0.05)), 6).alias("p5"), F.round(F.percentile("__s", F.lit(0.95)), 6).alias("p95"),
        F.round(F.avg((F.col("__s") > most).cast("double")), 6).alias("over_rate"), F.round(F.avg((F.col("__s") < least).cast("double")), 6).alias("under_rate"))


def is_present(df: DataFrame, name: str) -> Column:
    """Non-null and neither '' nor an empty array or map."""
    c, kind = F.col(name), df.schema[name].dataType.typeName()
    if kind == "string":
        return c.isNotNull() & (c != "")
    if kind in ("array", "map"):
        return c.isNotNull() & (F.size(c) > 0)
    return c.isNotNull()


def completeness(df: DataFrame, fields: list[str]) -> DataFrame:
    """``field, presence, critical``: share of rows in which a field is present; critical below 0.9. One pass, one row per field."""
    one = df.agg(*[F.round(F.avg(F.coalesce(is_present(df, f), F.lit(False)).cast("double")), 6).alias(f) for f in fields])
    return one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("presence")) for f in fields])).alias("x")).select("x.field", "x.presence", (F.col("x.presence") < 0.9).alias("critical"))


def latency_stats(df: DataFrame, stage: str, ms: str, limits: Column) -> DataFrame:
    """Per stage: count, mean, deviation, extremes, interpolated percentiles, share within its limit and whether the 95th percentile is."""
    x = df.withColumn("__l", limits.cast("double"))
    v = F.col(ms)
    return x.groupBy(F.col(stage).alias("stage")).agg(
        F.count(v).alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp(v), F.lit(0.0)), 6).alias("std"), F.min(v).alias("least"), F.max(v).alias("most"),
        F.round(F.percentile(v, F.lit(0.5)), 6).alias("p50"), F.round(F.percentile(v, F.lit(0.95)), 6).alias("p95"), F.round(F.percentile(v, F.lit(0.99)), 6).alias("p99"),
        F.round(F.avg((v <= F.col("__l")).cast("double")), 6).alias("within"), (F.percentile(v, F.lit(0.95)) <= F.max("__l")).alias("p95_ok"))


def entropy_diversity(df: DataFrame, by: str, kind: str) -> DataFrame:
    """Shannon entropy of the kinds of each group over the log of their number; 0 for one kind."""
    n = df.groupBy(by, kind).agg(F.count("*").alias("n"))
    total = n.groupBy(by).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    p = F.col("n") / F.col("total")
    out = n.join(total, by).groupBy(by, "kinds", "total").agg(F.sum(-p * F.log2(p)).alias("h"))
    return out.select(by, "kinds", "total", F.round(F.when(F.col("kinds") > 1, F.col("h") / F.log2(F.col("kinds").cast("double"))).otherwise(0.0), 6).alias("diversity"))
