"""Problem 2: continuous periods and gaps of each video's transcript chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.intervals import periods_and_gaps, whole_units
from lectern.session import latest, table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = latest(table(spark, sf_dir, "youtube_chunks"), ["chunk_id"], ["video_id", "start_sec", "end_sec"])
    out = periods_and_gaps(chunks, "video_id", whole_units(F.col("start_sec")), whole_units(F.col("end_sec")))
    return out.select("video_id", "kind", F.col("start_unit").alias("start_ms"), F.col("end_unit").alias("end_ms"))


P2_SQL = """
WITH r AS (SELECT chunk_id, video_id, start_sec, end_sec,
                  row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC NULLS LAST, video_id DESC NULLS LAST, start_sec DESC NULLS LAST, end_sec DESC NULLS LAST) AS rn
           FROM youtube_chunks),
c AS (SELECT video_id, CAST(round(start_sec * 1000) AS BIGINT) AS s, CAST(round(end_sec * 1000) AS BIGINT) AS e FROM r
      WHERE rn = 1 AND video_id IS NOT NULL AND isfinite(start_sec) AND isfinite(end_sec)),
v AS (SELECT * FROM c WHERE e > s),
m AS (SELECT *, max(e) OVER (PARTITION BY video_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM v),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m),
p AS (SELECT video_id, min(s) AS s, max(e) AS e FROM g GROUP BY video_id, island),
n AS (SELECT *, lead(s) OVER (PARTITION BY video_id ORDER BY s) AS nxt FROM p)
SELECT video_id, 'period' AS kind, s AS start_ms, e AS end_ms FROM p
UNION ALL SELECT video_id, 'gap' AS kind, e AS start_ms, nxt AS end_ms FROM n WHERE nxt IS NOT NULL
"""

QUERIES = {"p2_found": p2_found}
SQL = {"p2_found": P2_SQL}
