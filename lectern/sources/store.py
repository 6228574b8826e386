"""Sinks: a vector table partitioned by index and namespace, upserts by id, JSON dumps, course invalidation, index statistics."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Longest texts and lists kept with a record.
LONGEST = {"raw_text": 8000, "tables_text": 4000, "image_summaries": 8000, "text_preview": 300, "summary": 1000, "topic": 200}
MOST = {"questions": 30, "answers": 30, "keywords": 50, "concepts": 50, "warnings": 20, "stages": 30, "heading_path": 20}


def capped(df: DataFrame) -> DataFrame:
    """Texts and lists cut to what a record may hold; other columns as they are."""
    out = {}
    for f in df.schema:
        if f.name in LONGEST and f.dataType.typeName() == "string":
            out[f.name] = F.substring(f.name, 1, LONGEST[f.name])
        elif f.name in MOST and f.dataType.typeName() == "array":
            out[f.name] = F.slice(f.name, 1, MOST[f.name])
    return df.withColumns(out) if out else df


class VectorTable:
    """Parquet files below ``path/index_name=…/namespace=…``; a write replaces records of equal id and leaves other partitions alone."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _exists(self) -> bool:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop)

    def read(self, index_name: str | None = None, namespace: str | None = None) -> DataFrame:
        """Records, pruned to one index and namespace where these are given."""
        df = self.spark.read.parquet(self.path)
        for c, v in (("index_name", index_name), ("namespace", namespace)):
            df = df.where(F.col(c) == v) if v is not None else df
        return df

    def upsert(self, records: DataFrame, id_col: str = "id", version: str = "updated_at") -> None:
        """Append ``records`` over what is there: of equal ids the latest version holds. Only partitions that records go to are rewritten."""
        new = capped(records)
        if self._exists():
            touched = new.select("index_name", "namespace").distinct()
            old = self.read().join(touched, ["index_name", "namespace"], "left_semi").join(new.select("index_name", "namespace", id_col).distinct(), ["index_name", "namespace", id_col], "left_anti")
            new = new.unionByName(old.select(*new.columns), allowMissingColumns=True)
        rest = [c for c in new.columns if c not in ("index_name", "namespace", id_col)]
        one = new.groupBy("index_name", "namespace", id_col).agg(F.max_by(F.struct(*rest), version).alias("r")).select(id_col, "r.*", "index_name", "namespace")
        from lectern.session import materialize

        # written aside first: the table cannot be read and replaced in one plan
        held = materialize(one, "upsert")
        held.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("index_name", "namespace").parquet(self.path)

    def stats(self) -> DataFrame:
        """Records per index and namespace, with totals."""
        return self.read().rollup("index_name", "namespace").agg(F.count("*").alias("records"))

    def invalidate(self, index_name: str) -> int:
        """Delete an index; returns the number of records it held."""
        n = self.read(index_name).count()
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(os.path.join(self.path, f"index_name={index_name}"))
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        return n


def dump_json(df: DataFrame, path: str) -> None:
    """One JSON object a line."""
    df.write.mode("overwrite").json(path)
