"""Changes to related tables as plans: idempotent inserts, cascading deletes, choices by rank, membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_new(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The table with those rows whose key it does not hold; repeated new keys are inserted once. Rows with a null in their key are always new, as for a unique constraint."""
    whole = F.lit(True)
    for k in keys:
        whole &= F.col(k).isNotNull()
    keyed = rows.where(whole).dropDuplicates(keys).join(table.select(*keys).distinct(), keys, "left_anti").select(*table.columns)
    return table.unionByName(keyed).unionByName(rows.where(~whole).select(*table.columns))


def delete_cascade(parent: DataFrame, key: str, gone: Column, children: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """Parent and child tables without the parents for which ``gone`` holds, and without what hangs on them."""
    dead = parent.where(gone).select(F.col(key).alias("__dead")).distinct()
    out = {"": parent.where(~F.coalesce(gone, F.lit(False)))}
    for name, (child, fk) in children.items():
        out[name] = child.join(dead, F.col(fk) == F.col("__dead"), "left_anti")
    return out


def choose_first(df: DataFrame, key: list[str], preference: list[Column]) -> DataFrame:
    """The row of each key that comes first by ``preference`` (ties: any one, so end the list with a unique column).

    A partial minimum runs before the shuffle, so a key may hold any number of rows.
    """
    rest = [c for c in df.columns if c not in key]
    order = F.struct(*[p.alias(f"p{i}") for i, p in enumerate(preference)])
    return df.withColumn("__p", order).groupBy(*key).agg(F.min_by(F.struct(*rest), "__p").alias("__r")).select(*key, "__r.*")


def choose_transcript(transcripts: DataFrame, languages: list[str]) -> DataFrame:
    """One transcript per video: manual before generated, then by the order of ``languages``, then any other language by name."""
    rank = F.array_position(F.array(*[F.lit(x) for x in languages]), F.col("language"))
    return choose_first(transcripts, ["video_id"], [F.coalesce("is_generated", F.lit(True)), F.when(rank > 0, rank).otherwise(len(languages) + 1), F.coalesce("language", F.lit("~"))])


def numbered(df: DataFrame, key: str, order: list[str], out: str = "position") -> DataFrame:
    """0-based positions within keys of bounded size; for keys of any size use ``sequence.ordinals``."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)


def clamped(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Columns held within their ranges; nulls stay null."""
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c), F.lit(high)), F.lit(low))).cast(df.schema[c].dataType) for c, (low, high) in ranges.items() if c in df.columns})
