"""Ordinals, predecessors and windows along a key that may hold a third of all rows.

A plain window over such a key puts it into one task. Here rows are ranked within shards of the order column (``floor(order / width)``), and
only one summary row per shard is looked at along the key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs_of(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """(key, rows) of each run of equal ``keys`` in sorted batches, also across their ends; a run is held whole, so it must be bounded."""
    held, key = [], None
    for pdf in batches:
        if not len(pdf):
            continue
        columns = [pdf[k].tolist() for k in keys]
        marks = list(zip(*columns))
        begin = 0
        for i in range(1, len(marks) + 1):
            if i < len(marks) and marks[i] == marks[begin]:
                continue
            if held and marks[begin] != key:
                yield key, pd.concat(held) if len(held) > 1 else held[0]
                held = []
            key = marks[begin]
            held.append(pdf.iloc[begin:i])
            begin = i
    if held:
        yield key, pd.concat(held) if len(held) > 1 else held[0]


def _sharded(df: DataFrame, order: str, width: float) -> DataFrame:
    c = F.col(order).cast("double")
    shard = F.when(c.isNull(), F.lit(-(2**40))).when(F.isnan(c) | (F.abs(c) > 1e15), F.lit(2**40)).otherwise(F.floor(c / width))
    return df.withColumn("__shard", shard.cast("long"))


def ordinals(df: DataFrame, key: str, order: list[str], width: float, out: str = "ordinal") -> DataFrame:
    """Adds the 0-based position of each row of a key by ``order`` (nulls first, NaN last); the first column is numeric and sharded."""
    x = _sharded(df, order[0], width)
    sizes = x.groupBy(key, "__shard").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(key).orderBy("__shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col(key).alias("__key"), F.col("__shard").alias("__s"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    x = x.join(sizes, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__shard") == F.col("__s")))
    rank = F.row_number().over(Window.partitionBy(key, "__shard").orderBy(*order))
    return x.withColumn(out, F.col("__base") + rank - 1).drop("__key", "__s", "__base", "__shard")


def previous(df: DataFrame, key: str, order: list[str], width: float, value: Column, out: str = "previous") -> DataFrame:
    """Adds ``value`` of the row before in the order of a key, null for its first row."""
    x = _sharded(df, order[0], width).withColumn("__v", value)
    place = F.struct(*[F.col(c) for c in order])
    lasts = x.groupBy(key, "__shard").agg(F.max_by(F.struct(F.col("__v").alias("v")), place).alias("__last"))
    along = Window.partitionBy(key).orderBy("__shard")
    lasts = lasts.select(F.col(key).alias("__key"), F.col("__shard").alias("__s"), F.lag("__last").over(along).alias("__before"))
    x = x.join(lasts, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__shard") == F.col("__s")))
    w = Window.partitionBy(key, "__shard").orderBy(*order)
    x = x.withColumn(out, F.when(F.row_number().over(w) == 1, F.col("__before.v")).otherwise(F.lag("__v").over(w)))
    return x.drop("__key", "__s", "__before", "__shard", "__v")


def sliding_windows(df: DataFrame, key: str, ordinal: str, size: int, overlap: int) -> DataFrame:
    """One row per row and window it falls in: windows of ``size`` rows every ``size - overlap``, the last reaching the end.

    Adds ``window_index``. Each row falls in at most ``ceil(size / step)`` windows, so no window is ever gathered here.
    """
    step = max(1, size - overlap)
    n = df.groupBy(F.col(key).alias("__k")).agg(F.max(ordinal).alias("__most"))
    last = F.ceil(F.greatest(F.col("__most") + 1 - size, F.lit(0)) / step).cast("long")
    x = df.join(n, F.col(key) == F.col("__k"))
    first = F.greatest(F.ceil((F.col(ordinal) - size + 1) / step), F.lit(0)).cast("long")
    upto = F.least(F.floor(F.col(ordinal) / step).cast("long"), last)
    return x.where(first <= upto).select("*", F.explode(F.sequence(first, upto)).alias("window_index")).drop("__k", "__most")


def _carried(df: DataFrame, key: str, order: list[str], width: float, per_shard: Column, upto: Column, within: Column, out: str) -> DataFrame:
    """Adds to each row of a (key, shard) what the shards before hold (``upto`` of the shards' values, along the key) combined with ``within`` (along the shard)."""
    x = _sharded(df, order[0], width)
    sums = x.groupBy(key, "__shard").agg(per_shard.alias("__one"))
    sums = sums.select(F.col(key).alias("__key"), F.col("__shard").alias("__s"), upto.alias("__base"))
    x = x.join(sums, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__shard") == F.col("__s")))
    return x.withColumn(out, within).drop("__key", "__s", "__base", "__shard")


def carry_forward(df: DataFrame, key: str, order: list[str], width: float, value: Column, out: str) -> DataFrame:
    """Adds the last non-null ``value`` of the rows of a key up to each row (null before the first)."""
    before = Window.partitionBy(key).orderBy("__shard").rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy(key, "__shard").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = df.withColumn("__v", value)
    place = F.struct(*[F.col(c) for c in order])
    last = F.max_by("__v", F.when(F.col("__v").isNotNull(), place))
    return _carried(x, key, order, width, last, F.last("__one", ignorenulls=True).over(before), F.coalesce(F.last("__v", ignorenulls=True).over(along), F.col("__base")), out).drop("__v")


def running_sum(df: DataFrame, key: str, order: list[str], width: float, value: Column, out: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows of a key before each row (0 for the first)."""
    before = Window.partitionBy(key).orderBy("__shard").rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy(key, "__shard").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    x = df.withColumn("__v", value)
    zero = F.lit(0).cast("long")
    return _carried(x, key, order, width, F.sum("__v"), F.coalesce(F.sum("__one").over(before), zero), F.coalesce(F.sum("__v").over(along), zero) + F.col("__base"), out).drop("__v")
