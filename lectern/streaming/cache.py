"""The query cache as a stateful stream: each bucket keeps its newest entries for a time to live; what leaves is reported."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.session import shared_dir


def _keep(most: int, live_seconds: int):
    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """State of a bucket: ids and times of its entries, newest last; never more than ``most`` of them."""
        ids, times = state.get if state.exists else ([], [])
        held = dict(zip(ids, times))
        out = []
        for pdf in batches:
            for i, at in sorted(zip(pdf["entry_id"], pdf["at"]), key=lambda x: (x[1], x[0])):
                held.pop(i, None)
                held[i] = int(at)
                out.append((*key, i, int(at), "stored"))
        ordered = sorted(held.items(), key=lambda x: (x[1], x[0]))
        now = ordered[-1][1] if ordered else 0
        kept = [x for x in ordered if x[1] + live_seconds > now]
        out += [(*key, i, at, "expired") for i, at in ordered if at + live_seconds <= now]
        out += [(*key, i, at, "evicted") for i, at in kept[:-most]]
        kept = kept[-most:]
        state.update(([i for i, _ in kept], [at for _, at in kept]))
        yield pd.DataFrame(out, columns=["course_id", "mode", "entry_id", "at", "action"])

    return keep


def cache_changes(entries: DataFrame, most: int = 200, live_seconds: int = 86_400) -> DataFrame:
    """``course_id, mode, entry_id, at, action`` of a stream ``course_id, mode, entry_id, created_at``.

    ``at`` is in seconds. An entry stored again is renewed. State is bounded by ``most`` entries a bucket. Rows with a null id or time are left out.
    """
    rows = entries.where("entry_id is not null and created_at is not null").select("course_id", "mode", "entry_id", F.unix_timestamp("created_at").alias("at"))
    return rows.groupBy("course_id", "mode").applyInPandasWithState(
        _keep(most, live_seconds), "course_id string, mode string, entry_id string, at long, action string", "ids array<string>, times array<long>", "append", GroupStateTimeout.NoTimeout)


def run_cache(spark: SparkSession, stream: DataFrame, folder: str | None = None, **kw) -> DataFrame:
    """All changes of what the stream holds now, as a table."""
    folder = folder or f"{shared_dir(spark)}/cache-{uuid.uuid4().hex}"

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/table/batch={number}")

    cache_changes(stream, **kw).writeStream.outputMode("append").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).foreachBatch(store).start().awaitTermination()
    return spark.read.parquet(f"{folder}/table")
