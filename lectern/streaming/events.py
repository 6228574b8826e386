"""Incremental ingestion by Structured Streaming: windowed counts and upserts into a table in the shared folder.

Each query reads what is there (``availableNow``) and ends; run again on the same folder it takes up only new files, as its
progress is kept there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import latest, shared_dir


def _stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream over a Parquet file or folder with the schema found there."""
    schema = spark.read.parquet(path).schema
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if there.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(there).isFile():
        return spark.readStream.schema(schema).option("pathGlobFilter", there.getName()).parquet(there.getParent().toString())
    return spark.readStream.schema(schema).parquet(path)


def windowed_counts(spark: SparkSession, path: str, folder: str | None = None, late: str = "3650 days") -> DataFrame:
    """``hour, event_type, events, total`` of an event stream; an event is late after ``late``. Null times are in no window."""
    folder = folder or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = _stream(spark, path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    by = events.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"))

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/table")

    by.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).foreachBatch(store).start().awaitTermination()
    got = spark.read.parquet(f"{folder}/table")
    return got.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "events", F.round("total", 4).alias("total"))


def closed_windows(spark: SparkSession, path: str, folder: str | None = None, late: str = "10 minutes") -> DataFrame:
    """``hour, event_type, events, total`` of the hours that are over: append mode, so an hour is given once, when the watermark (``late`` behind the newest event) has
    passed its end, and its state is dropped. Events of such an hour that come afterwards are late and left out. Run again, it goes on from where it ended.
    """
    folder = folder or f"{shared_dir(spark)}/closed-{uuid.uuid4().hex}"
    events = _stream(spark, path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    by = events.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    rows = by.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "events", F.round("total", 4).alias("total"))

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/table/batch={number}")

    rows.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).foreachBatch(store).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/table").select(*rows.columns)


def ingest_upsert(spark: SparkSession, path: str, folder: str | None = None, key: str = "chunk_id", at: str = "ingested_at") -> DataFrame:
    """The table after a stream of records has been put into it: one row per key, the latest holds. Re-delivered records change nothing.

    Each batch appends its own latest rows; reading takes the latest per key, so a batch that is repeated after a failure is harmless.
    """
    folder = folder or f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    stream = _stream(spark, path)
    columns = [c for c in stream.columns if c not in (key, at)]

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/table/batch={number}")

    stream.writeStream.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).foreachBatch(store).start().awaitTermination()
    return latest(spark.read.schema(stream.schema).parquet(f"{folder}/table"), [key], columns, at)
