import datetime as dt

from lectern.streaming.cache import run_cache
from lectern.streaming.events import closed_windows, ingest_upsert, windowed_counts

T0 = dt.datetime(2025, 1, 1)


def test_cache_evicts_and_expires(spark, tmp_path):
    rows = [("c", "ask", f"e{i}", T0 + dt.timedelta(hours=i)) for i in range(5)] + [("c", "ask", "e0", T0 + dt.timedelta(hours=5)), ("c", "quiz", "q", T0), ("c", "quiz", None, T0), ("c", "quiz", "late", T0 + dt.timedelta(days=2))]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "course_id string, mode string, entry_id string, created_at timestamp").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    got = {(r["mode"], r["entry_id"], r["action"]) for r in run_cache(spark, stream, str(tmp_path / "out"), most=3).collect()}
    assert ("ask", "e1", "evicted") in got and ("ask", "e2", "evicted") in got and ("ask", "e0", "evicted") not in got
    assert ("quiz", "q", "expired") in got and ("quiz", "late", "stored") in got


def test_ingest_takes_up_only_new_files(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    kind = "chunk_id string, v int, ingested_at timestamp"
    spark.createDataFrame([("a", 1, T0), ("b", 1, T0)], kind).write.parquet(src)
    assert ingest_upsert(spark, src, out).count() == 2
    spark.createDataFrame([("a", 2, T0 + dt.timedelta(days=1)), ("a", 0, T0 - dt.timedelta(days=1)), ("c", 3, None)], kind).write.mode("append").parquet(src)
    assert {r["chunk_id"]: r["v"] for r in ingest_upsert(spark, src, out).collect()} == {"a": 2, "b": 1, "c": 3}


def test_windows_of_nothing_and_null_times(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(T0, "x", 1.0), (None, "x", 2.0)], "ts timestamp, event_type string, value double").write.parquet(src)
    assert [(r["events"], r["total"]) for r in windowed_counts(spark, src, str(tmp_path / "out")).collect()] == [(1, 1.0)]


def test_late_events_are_left_out_and_hours_given_once(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    kind = "ts timestamp, event_type string, value double"
    at = lambda h, m=0: T0 + dt.timedelta(hours=h, minutes=m)
    spark.createDataFrame([(at(0, 5), "x", 1.0), (at(1, 5), "x", 2.0), (at(1, 55), "x", 3.0), (at(3, 0), "x", 4.0), (None, "x", 9.0)], kind).coalesce(1).write.parquet(src)
    first = {r["hour"][11:13]: (r["events"], r["total"]) for r in closed_windows(spark, src, out).collect()}
    assert first == {"00": (1, 1.0), "01": (2, 5.0)}
    spark.createDataFrame([(at(1, 30), "x", 100.0), (at(2, 55), "x", 7.0), (at(5, 0), "x", 5.0)], kind).coalesce(1).write.mode("append").parquet(src)
    again = {r["hour"][11:13]: (r["events"], r["total"]) for r in closed_windows(spark, src, out).collect()}
    assert again == first | {"02": (1, 7.0), "03": (1, 4.0)}
