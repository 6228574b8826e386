"""Continuous periods and gaps of overlapping intervals, by compressed run bitmaps per entity and time shard.

Time is cut into whole units (milliseconds) and into shards of ``2**shard_bits`` units. Within a shard the set of covered
units is a bitmap kept in compressed form: the sorted list of its runs, as 32-bit offsets. Bitmaps are built per task
before any shuffle, united in two levels (the first salted, so an entity with a third of all rows is spread), and
their set runs (periods) and clear runs (gaps) are read off. Only the first and last run of a shard can touch another
shard; those alone are stitched along the entity.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class RunBitmap:
    """A bitmap over ``[0, 2**32)`` as sorted, disjoint, non-touching runs ``[start, end)``."""

    __slots__ = ("starts", "ends")

    def __init__(self, starts: np.ndarray, ends: np.ndarray):
        self.starts, self.ends = starts, ends

    @classmethod
    def of(cls, starts: np.ndarray, ends: np.ndarray) -> RunBitmap:
        """From any runs, overlapping or not."""
        if len(starts) == 0:
            return cls(np.empty(0, np.int64), np.empty(0, np.int64))
        order = np.argsort(starts, kind="stable")
        s, e = starts[order].astype(np.int64), np.maximum.accumulate(ends[order].astype(np.int64))
        new = np.concatenate(([True], s[1:] > e[:-1]))
        last = np.concatenate((new[1:], [True]))
        return cls(s[new], e[last])

    @classmethod
    def union(cls, parts: list[RunBitmap]) -> RunBitmap:
        return cls.of(np.concatenate([p.starts for p in parts]), np.concatenate([p.ends for p in parts]))

    def to_bytes(self) -> bytes:
        return np.stack([self.starts, self.ends - 1], axis=1).astype("<u4").tobytes() if len(self.starts) else b""

    @classmethod
    def from_bytes(cls, data: bytes) -> RunBitmap:
        a = np.frombuffer(data, "<u4").reshape(-1, 2).astype(np.int64)
        return cls(a[:, 0], a[:, 1] + 1)


#: Groups of a batch are kept apart by this offset, so that one pass over all runs unites each group for itself.
APART = 1 << 33


def unite_groups(group: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of each group united: (group, start, end) in order; starts and ends are within ``[0, 2**32]``."""
    b = RunBitmap.of(starts + group * APART, ends + group * APART)
    g = b.starts // APART
    return g, b.starts - g * APART, b.ends - g * APART


def _to_maps(group: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int) -> list[bytes]:
    """Compressed bitmaps of groups 0 to n - 1 from united runs."""
    flat = np.stack([starts, ends - 1], axis=1).astype("<u4")
    cut = np.searchsorted(group, np.arange(n + 1))
    return [flat[cut[i] : cut[i + 1]].tobytes() for i in range(n)]


def _from_maps(lists) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of all runs of rows that each hold a list of compressed bitmaps."""
    joined = [b"".join(x) for x in lists]
    runs = np.frombuffer(b"".join(joined), "<u4").reshape(-1, 2).astype(np.int64)
    return np.repeat(np.arange(len(joined)), [len(x) // 8 for x in joined]), runs[:, 0], runs[:, 1] + 1


def _build(bits: int):
    def build(batches):
        """Bitmaps of a task's rows: one per entity and shard in each batch."""
        for pdf in batches:
            if not len(pdf):
                continue
            low = pdf["__shard"].to_numpy(np.int64) << bits
            group, keys = pd.factorize(pd.MultiIndex.from_arrays([pdf["__entity"], pdf["__shard"]]))
            s, e = np.maximum(pdf["__s"].to_numpy(np.int64) - low, 0), np.minimum(pdf["__e"].to_numpy(np.int64) - low, 1 << bits)
            maps = _to_maps(*unite_groups(group.astype(np.int64), s, e), len(keys))
            yield pd.DataFrame({"__entity": keys.get_level_values(0), "__shard": keys.get_level_values(1), "__map": maps})

    return build


def _unite(batches):
    for pdf in batches:
        yield pd.DataFrame({"__entity": pdf["__entity"], "__shard": pdf["__shard"], "__map": _to_maps(*unite_groups(*_from_maps(pdf["__maps"])), len(pdf))})


def _runs(bits: int):
    def runs(batches):
        """Set and clear runs of each shard; ``edge`` marks the set runs that another shard may continue."""
        for pdf in batches:
            row, s, e = unite_groups(*_from_maps(pdf["__maps"]))
            if not len(row):
                continue
            low = (pdf["__shard"].to_numpy(np.int64) << bits)[row]
            change = row[1:] != row[:-1]
            edge = np.concatenate(([True], change)) | np.concatenate((change, [True]))
            entity = pdf["__entity"].to_numpy()[row]
            inner = np.nonzero(~change)[0]
            shard = low >> bits
            yield pd.DataFrame({"__entity": entity, "__shard": shard, "kind": "period", "edge": edge, "s": s + low, "e": e + low})
            yield pd.DataFrame({"__entity": entity[inner], "__shard": shard[inner], "kind": "gap", "edge": False, "s": (e + low)[inner], "e": (s + low)[inner + 1]})

    return runs


def whole_units(seconds: Column, per_second: int = 1000) -> Column:
    """Seconds as whole units, half away from zero; null for null, NaN and infinite values and those beyond 2**52."""
    ok = seconds.isNotNull() & ~F.isnan(seconds) & (F.abs(seconds) < F.lit(float(2**52 // per_second)))
    return F.when(ok, F.round(F.when(ok, seconds) * per_second).cast("long"))


def _united(cut: DataFrame, entity_type: str, bits: int, salts: int) -> DataFrame:
    """Set and clear runs (``__entity, __shard, kind, edge, s, e``) of rows that are cut by shard (``__entity, __s, __e, __shard``)."""
    kind = f"__entity {entity_type}, __shard long, __map binary"
    maps = cut.mapInPandas(_build(bits), kind)
    listed = F.collect_list("__map").alias("__maps")
    salted = maps.groupBy("__entity", "__shard", (F.spark_partition_id() % salts).alias("__salt")).agg(listed).drop("__salt").mapInPandas(_unite, kind)
    return salted.groupBy("__entity", "__shard").agg(listed).mapInPandas(_runs(bits), f"__entity {entity_type}, __shard long, kind string, edge boolean, s long, e long")


def _stitched(edges: DataFrame) -> DataFrame:
    """Edge runs with the chain of touching runs they belong to and the start of the next run along their entity."""
    along = Window.partitionBy("__entity").orderBy("s")
    chained = edges.withColumn("new", F.coalesce(F.lag("e").over(along) < F.col("s"), F.lit(True)).cast("int"))
    return chained.withColumn("chain", F.sum("new").over(along)).withColumn("next", F.lead("s").over(along))


def periods_and_gaps(df: DataFrame, entity: str, start_unit: Column, end_unit: Column, shard_bits: int = 22, salts: int = 16) -> DataFrame:
    """Periods and gaps per entity: columns ``entity``, ``kind`` ('period' or 'gap'), ``start_unit``, ``end_unit``.

    A row counts if entity and both units are present and the end lies after the start; units may be negative. Touching
    and nested rows make one period; repeated rows change nothing; an empty table gives an empty result; other columns
    are ignored whatever their names. A row costs at most three pieces, however long it is: beyond three shards (of 70 minutes at millisecond units)
    its whole shards are a run of a coarser bitmap whose unit is the shard. A task of the last union holds at most ``salts`` bitmaps per input task of one shard.
    """
    entity_type = df.schema[entity].dataType.simpleString()
    size = 1 << shard_bits
    rows = df.select(F.col(entity).alias("__entity"), start_unit.alias("__s"), end_unit.alias("__e")).where(
        F.col("__entity").isNotNull() & F.col("__s").isNotNull() & F.col("__e").isNotNull() & (F.col("__e") > F.col("__s"))
    )
    first, last = F.floor(F.col("__s") / size).cast("long"), F.floor((F.col("__e") - 1) / size).cast("long")
    rows = rows.withColumn("__first", first).withColumn("__last", last)
    pieces = F.when(F.col("__last") - F.col("__first") <= 2, F.sequence("__first", F.least(F.col("__last"), F.col("__first") + 2))).otherwise(F.array("__first", "__last"))
    runs = _united(rows.select("__entity", "__s", "__e", F.explode(pieces).alias("__shard")), entity_type, shard_bits, salts)

    # whole shards of long rows: shards are the units of a second, coarser level (at 2**22 shards a coarse shard, 2**52 units are 256 of them)
    coarse_bits = min(31, max(22, 44 - shard_bits))
    long = rows.where("__last - __first > 2").select("__entity", (F.col("__first") + 1).alias("__s"), F.col("__last").alias("__e"))
    coarse_size = 1 << coarse_bits
    coarse = long.select("*", F.explode(F.sequence(F.floor(F.col("__s") / coarse_size).cast("long"), F.floor((F.col("__e") - 1) / coarse_size).cast("long"))).alias("__shard"))
    coarse = _united(coarse, entity_type, coarse_bits, salts).where("kind = 'period'")
    whole = _stitched(coarse.where("edge")).groupBy("__entity", "chain").agg(F.min("s").alias("s"), F.max("e").alias("e")).select("__entity", "s", "e").unionByName(coarse.where(~F.col("edge")).select("__entity", "s", "e"))

    # shards under a coarse run have nothing of their own to tell: one row per shard is looked at along an entity
    marks = runs.select("__entity", F.col("__shard").alias("at"), F.lit(None).cast("long").alias("upto")).distinct().unionByName(whole.select("__entity", F.col("s").alias("at"), F.col("e").alias("upto")))
    over = Window.partitionBy("__entity").orderBy("at", F.col("upto").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    open_shards = marks.withColumn("covered", F.max("upto").over(over)).where(F.col("upto").isNull() & (F.col("covered").isNull() | (F.col("covered") <= F.col("at")))).select("__entity", F.col("at").alias("__shard"))
    runs = runs.join(open_shards, ["__entity", "__shard"], "left_semi")

    edges = runs.where("edge").select("__entity", "s", "e").unionByName(whole.select("__entity", (F.col("s") * size).alias("s"), (F.col("e") * size).alias("e")))
    chained = _stitched(edges)
    across = chained.where((F.col("next") > F.col("e")) & (F.floor(F.col("next") / size) > F.floor((F.col("e") - 1) / size)))
    out = (
        chained.groupBy("__entity", "chain").agg(F.min("s").alias("s"), F.max("e").alias("e")).select("__entity", F.lit("period").alias("kind"), "s", "e")
        .unionByName(across.select("__entity", F.lit("gap").alias("kind"), F.col("e").alias("s"), F.col("next").alias("e")))
        .unionByName(runs.where(~F.col("edge")).select("__entity", "kind", "s", "e"))
    )
    return out.select(F.col("__entity").alias(entity), "kind", F.col("s").alias("start_unit"), F.col("e").alias("end_unit"))
