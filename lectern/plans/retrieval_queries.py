"""Retrieval queries over the test tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import JUDGING_STOP_WORDS, STOP_WORDS, query_hash
from lectern.operators.retrieval import bm25_topk, dense_topk, keep_newest, metadata_filter, mmr_select, reciprocal_rank_fusion
from lectern.session import latest, table

STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)
JUDGING_SQL = "list_distinct(list_filter(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9_]{{3,}}'), lambda t: t NOT IN (" + ", ".join(f"'{w}'" for w in JUDGING_STOP_WORDS) + ")))"
TOKENS_SQL = "list_filter(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9_]{{2,}}'), lambda t: t NOT IN (" + STOP_SQL + "))"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _dense(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return dense_topk(v, v.where("id % 20 = 0"), k)


def dense_top8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir, 8).select("query_id", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


DENSE_SQL = """
WITH s AS (SELECT q.vec_id AS query_id, q.label AS query_label, v.vec_id, v.label, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score
           FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s)
"""


def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per query: reciprocal rank, precision, recall, hit, and NDCG at 10 with exponential and linear gain; a neighbour of the query's label has grade 2."""
    v = _vectors(spark, sf_dir)
    k = 10
    top = _dense(spark, sf_dir, k).join(v.select("id", F.col("label").alias("found")), "id").join(v.select(F.col("id").alias("query_id"), "label"), "query_id")
    sizes = v.groupBy("label").agg((F.count("*") - 1).alias("relevant"))
    top = top.join(sizes, "label").withColumn("hit", (F.col("found") == F.col("label")).cast("int"))
    discount = F.log2(F.col("rank") + 1.0)
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.greatest(F.col("relevant"), F.lit(1)), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    out = top.groupBy("query_id", "relevant").agg(
        F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"), F.sum("hit").alias("hits"), F.count("*").alias("n"),
        F.sum(F.col("hit") * 3 / discount).alias("exp_gain"), F.sum(F.col("hit") * 2 / discount).alias("lin_gain"))
    norm = F.when(F.col("relevant") > 0, ideal).otherwise(F.lit(1.0))
    return out.select(
        "query_id", F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"), F.round(F.col("hits") / F.lit(k), 6).alias("precision_at_10"),
        F.round(F.coalesce(F.try_divide(F.col("hits"), F.col("relevant")), F.lit(0.0)), 6).alias("recall_at_10"), (F.col("hits") > 0).cast("int").alias("hit_at_10"),
        F.round(F.col("exp_gain") / (3 * norm), 6).alias("ndcg_exp"), F.round(F.col("lin_gain") / (2 * norm), 6).alias("ndcg_linear"))


METRICS_SQL = DENSE_SQL + """, t AS (SELECT r.*, (label = query_label)::INT AS hit FROM r WHERE rank <= 10),
z AS (SELECT label, count(*) - 1 AS relevant FROM embeddings GROUP BY label),
g AS (SELECT query_id, any_value(z.relevant) AS relevant, min(CASE WHEN hit = 1 THEN rank END) AS first, sum(hit) AS hits, sum(hit * 3 / log2(rank + 1)) AS eg, sum(hit * 2 / log2(rank + 1)) AS lg
      FROM t JOIN z ON z.label = t.query_label GROUP BY query_id),
i AS (SELECT *, CASE WHEN relevant > 0 THEN list_sum(list_transform(range(1, least(greatest(relevant, 1), 10)::BIGINT + 1), lambda x: 1 / log2(x + 1))) ELSE 1.0 END AS ideal FROM g)
SELECT query_id, round(coalesce(1.0 / first, 0), 6) AS mrr, round(hits / 10.0, 6)::DOUBLE AS precision_at_10, round(CASE WHEN relevant > 0 THEN hits::DOUBLE / relevant ELSE 0 END, 6) AS recall_at_10,
       (hits > 0)::INT AS hit_at_10, round(eg / (3 * ideal), 6) AS ndcg_exp, round(lg / (2 * ideal), 6) AS ndcg_linear FROM i
"""


def semantic_cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest cached vector of each query if it is at least 0.35 alike, as a hit with its score; else a miss (-1, 0)."""
    best = _dense(spark, sf_dir, 1)
    q = _vectors(spark, sf_dir).where("id % 20 = 0").select(F.col("id").alias("query_id"))
    hit = F.coalesce(F.col("score") >= 0.35, F.lit(False))
    return q.join(best, "query_id", "left").select("query_id", hit.alias("hit"), F.when(hit, F.col("id")).otherwise(-1).alias("entry_id"), F.when(hit, F.round("score", 6)).otherwise(0.0).alias("score"))


CACHE_SQL = DENSE_SQL + """SELECT query_id, score >= 0.35 AS hit, CASE WHEN score >= 0.35 THEN vec_id ELSE -1 END AS entry_id, CASE WHEN score >= 0.35 THEN round(score, 6) ELSE 0 END AS score FROM r WHERE rank = 1"""


def bm25_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a course ranked for the titles of those whose id is divisible by 20."""
    docs = table(spark, sf_dir, "documents").where("course_id is not null").select(F.col("course_id").alias("grp"), F.col("doc_id").alias("id"), "text", "title")
    asked = docs.where("id % 20 = 0").select(F.col("id").alias("query_id"), "grp", F.col("title").alias("text"))
    return bm25_topk(docs.drop("title"), asked, 10).select("query_id", F.col("id").alias("doc_id"), "score", "rank")


BM25_SQL = f"""
WITH d AS (SELECT course_id AS grp, doc_id AS id, {TOKENS_SQL.format('text')} AS toks, {TOKENS_SQL.format('title')} AS asks FROM documents WHERE course_id IS NOT NULL),
w AS (SELECT grp, id, unnest(toks) AS term FROM d), tf AS (SELECT grp, term, id, count(*) AS tf FROM w GROUP BY ALL),
st AS (SELECT grp, count(*) AS n, avg(len(toks)) AS avg_len FROM d GROUP BY grp),
df AS (SELECT tf.grp, term, n, avg_len, ln((n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf JOIN st USING (grp) GROUP BY tf.grp, term, n, avg_len),
m AS (SELECT grp, avg(idf) AS mean_idf FROM df GROUP BY grp),
q AS (SELECT query_id, grp, term, count(*) AS qtf FROM (SELECT id AS query_id, grp, unnest(asks) AS term FROM d WHERE id % 20 = 0) GROUP BY ALL),
h AS (SELECT query_id, tf.id, sum(qtf * (CASE WHEN idf < 0 THEN 0.25 * mean_idf ELSE idf END) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(toks) / avg_len))) AS raw
      FROM q JOIN df USING (grp, term) JOIN m USING (grp) JOIN tf USING (grp, term) JOIN d ON d.grp = q.grp AND d.id = tf.id GROUP BY query_id, tf.id),
s AS (SELECT query_id, id, round(raw / (CASE WHEN max(raw) OVER (PARTITION BY query_id) > 0 THEN max(raw) OVER (PARTITION BY query_id) ELSE 1 END), 6) AS score FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
SELECT query_id, id AS doc_id, score, rank FROM r WHERE rank <= 10
"""


def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lexical lists of the same course fused: documents ranked for the asked title by BM25 over their texts (weight 1.2), boosted where they have a title, and over their titles (weight 1)."""
    d = table(spark, sf_dir, "documents").where("course_id is not null").select(F.col("course_id").alias("grp"), F.col("doc_id").alias("id"), "text", "title")
    asked = d.where("id % 20 = 0").select(F.col("id").alias("query_id"), "grp", F.col("title").alias("text"))
    boost = F.when(F.col("title").isNotNull(), F.lit(1.1)).otherwise(1.0)
    by_text = bm25_topk(d.drop("title"), asked, 10).join(d.select("id", boost.alias("boost")), "id").select("query_id", "id", F.lit("text").alias("method"), "rank", F.lit(1.2).alias("weight"), "boost")
    by_title = bm25_topk(d.select("grp", "id", F.col("title").alias("text")), asked, 10).select("query_id", "id", F.lit("title").alias("method"), "rank", F.lit(1.0).alias("weight"), F.lit(1.0).alias("boost"))
    return reciprocal_rank_fusion(by_text.unionByName(by_title), 8).select("query_id", F.col("id").alias("doc_id"), F.round("rrf", 6).alias("rrf"), "methods", "rank")


def _bm25_named(prefix: str, source: str) -> str:
    """The ranking of BM25_SQL with all its parts named apart, over the tokens of ``source``."""
    import re

    body = BM25_SQL.strip().removeprefix("WITH ").rsplit("SELECT query_id, id AS doc_id", 1)[0]
    body = body.replace(TOKENS_SQL.format("text") + " AS toks", TOKENS_SQL.format(source) + " AS toks")
    for name in ("d", "w", "tf", "st", "df", "m", "q", "h", "s", "r"):
        body = re.sub(rf"(?<![\w.']){name}(?= AS \()|(?<=FROM ){name}(?![\w.])|(?<=JOIN ){name}(?![\w.])", f"{prefix}_{name}", body)
        if name != "tf":
            body = re.sub(rf"(?<![\w.']){name}\.", f"{prefix}_{name}.", body)
    return re.sub(r"(?<![\w.'])tf\.", f"{prefix}_tf.", body)


RRF_SQL = "WITH " + _bm25_named("x", "text").strip() + ", " + _bm25_named("y", "title").strip() + """,
l AS (SELECT query_id, x_r.id, 'text' AS method, rank, 1.2::DOUBLE * CASE WHEN title IS NOT NULL THEN 1.1::DOUBLE ELSE 1 END AS weight FROM x_r JOIN documents ON doc_id = x_r.id WHERE rank <= 10 UNION ALL SELECT query_id, id, 'title', rank, 1.0::DOUBLE FROM y_r WHERE rank <= 10),
f AS (SELECT query_id, id AS doc_id, round(sum(weight / (60 + rank)), 9) AS rrf, string_agg(DISTINCT method, '+' ORDER BY method) AS methods FROM l GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, doc_id) AS rank FROM f)
SELECT query_id, doc_id, round(rrf, 6) AS rrf, methods, rank FROM k WHERE rank <= 8
"""


def mmr_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = _dense(spark, sf_dir, 20).join(_vectors(spark, sf_dir).select("id", "label"), "id")
    return mmr_select(top.select("query_id", "id", "score", F.col("label").cast("string").alias("file"), F.col("id").alias("position")), 6)


def metadata_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = latest(table(spark, sf_dir, "youtube_chunks"), ["chunk_id"], ["video_id", "chunk_index", "is_generated_transcript", "duration_sec", "start_sec"])
    keep = metadata_filter({"is_generated_transcript": True, "duration_sec": {"$gte": 300, "$lte": 2400}, "chunk_index": {"$gt": 0}})
    return c.where(keep).select("chunk_id", "video_id", "chunk_index", "duration_sec")


LATEST_CHUNKS = "(SELECT * FROM youtube_chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC NULLS LAST) = 1)"
FILTER_SQL = f"SELECT chunk_id, video_id, chunk_index, duration_sec FROM {LATEST_CHUNKS} WHERE is_generated_transcript AND duration_sec BETWEEN 300 AND 2400 AND chunk_index > 0"


def _cache_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct exchanges as cache entries: mode by how the message begins."""
    h = table(spark, sf_dir, "chat_history").select("id", "course_id", "message", "created_at").distinct()
    mode = F.when(F.col("message").startswith("Summary"), "summarize").when(F.col("message").startswith("Flashcards"), "quiz").otherwise("ask")
    return h.select("id", "course_id", mode.alias("mode"), "message", "created_at")


def cache_query_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cache_entries(spark, sf_dir).select("id", "mode", query_hash(F.col("message"), F.col("mode")).alias("query_hash"))


ENTRIES_SQL = """e AS (SELECT DISTINCT id, course_id, message, created_at, CASE WHEN message LIKE 'Summary%' THEN 'summarize' WHEN message LIKE 'Flashcards%' THEN 'quiz' ELSE 'ask' END AS mode FROM chat_history)"""
HASH_SQL = "WITH " + ENTRIES_SQL + r" SELECT id, mode, sha256(trim(regexp_replace(lower(message), '\s+', ' ', 'g')) || '|' || mode) AS query_hash FROM e"


def cache_evicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_newest(_cache_entries(spark, sf_dir), ["course_id", "mode"], "created_at", "id", 20).select("course_id", "mode", "id")


EVICT_SQL = "WITH " + ENTRIES_SQL + " SELECT course_id, mode, id FROM e QUALIFY row_number() OVER (PARTITION BY course_id, mode ORDER BY created_at DESC, id DESC) <= 20"


def cache_live_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that live a day, as of one day after the newest entry less twelve hours."""
    e = _cache_entries(spark, sf_dir)
    now = e.agg((F.max("created_at") + F.expr("interval 12 hours")).alias("now"))
    return e.join(F.broadcast(now)).where(F.col("created_at") + F.expr("interval 24 hours") > F.col("now")).select("id", "mode")


LIVE_SQL = "WITH " + ENTRIES_SQL + " SELECT id, mode FROM e WHERE created_at + INTERVAL 24 HOUR > (SELECT max(created_at) + INTERVAL 12 HOUR FROM e)"


def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries per course and mode, zeros included."""
    e = _cache_entries(spark, sf_dir)
    modes = F.explode(F.array(*[F.lit(m) for m in ("ask", "quiz", "summarize")])).alias("mode")
    grid = e.select("course_id").distinct().select("course_id", modes)
    n = e.groupBy("course_id", "mode").agg(F.count("*").alias("n"))
    return grid.join(n, ["course_id", "mode"], "left").select("course_id", "mode", F.coalesce("n", F.lit(0)).alias("entries"))


STATS_SQL = "WITH " + ENTRIES_SQL + """, g AS (SELECT course_id, mode FROM (SELECT DISTINCT course_id FROM e), (SELECT unnest(['ask', 'quiz', 'summarize']) AS mode))
SELECT g.course_id, g.mode, count(e.id) AS entries FROM g LEFT JOIN e ON g.course_id = e.course_id AND g.mode = e.mode GROUP BY ALL"""


def cache_exact_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that an earlier one answers: the same question (by its hash) in the same course and mode, not more than a day before."""
    from lectern.operators.sequence import previous

    e = _cache_entries(spark, sf_dir).select("id", "course_id", "mode", F.concat_ws("#", "course_id", query_hash(F.col("message"), F.col("mode"))).alias("key"), F.unix_micros("created_at").alias("at"))
    x = previous(e, "key", ["at", "id"], 86_400e6 * 30, F.struct("id", "at"), "before")
    hit = F.coalesce(F.col("at") - F.col("before.at") < 86_400_000_000, F.lit(False))
    return x.select("id", "mode", hit.alias("hit"), F.when(hit, F.col("before.id")).alias("answered_by"))


EXACT_SQL = "WITH " + ENTRIES_SQL + r""", k AS (SELECT *, lag(id) OVER w AS b, lag(created_at) OVER w AS t FROM (SELECT *, concat_ws('#', course_id, sha256(trim(regexp_replace(lower(message), '\s+', ' ', 'g')) || '|' || mode)) AS key FROM e) WINDOW w AS (PARTITION BY key ORDER BY created_at, id))
SELECT id, mode, coalesce(created_at - t < INTERVAL 24 HOUR, false) AS hit, CASE WHEN created_at - t < INTERVAL 24 HOUR THEN b END AS answered_by FROM k"""

MMR_SQL = DENSE_SQL.strip().replace("WITH s AS", "WITH RECURSIVE s AS", 1) + """,
c AS (SELECT query_id, vec_id AS id, score, label::VARCHAR AS file, vec_id AS pos, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS o FROM r WHERE rank <= 20),
p AS (SELECT query_id, 1 AS pick, id, [{'id': id, 's': score, 'f': file, 'p': pos}] AS chosen FROM c WHERE o = 1
 UNION ALL SELECT query_id, pick + 1, id, list_append(chosen, {'id': id, 's': score, 'f': file, 'p': pos}) FROM (SELECT query_id, pick, c.id, score, file, pos, o, chosen,
  0.6::DOUBLE * score - 0.4::DOUBLE * list_max(list_transform(chosen, lambda x: CASE WHEN x.f = file THEN CASE WHEN abs(x.p - pos) <= 2 THEN 0.85::DOUBLE ELSE 0.5::DOUBLE END ELSE x.s * score END)) AS gain
  FROM p JOIN c USING (query_id) WHERE pick < 6 AND NOT list_contains(list_transform(chosen, lambda x: x.id), c.id)) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, o) = 1)
SELECT query_id, id, pick::INT AS pick FROM p"""

QUERIES = {
    "cache_exact_hits": cache_exact_hits,
    "dense_topk": dense_top8, "retrieval_metrics": retrieval_metrics, "semantic_cache_lookup": semantic_cache_lookup, "bm25_candidates": bm25_titles, "rrf_fusion": rrf_hybrid, "mmr_select": mmr_picks,
    "metadata_filter": metadata_filtered, "cache_query_hash": cache_query_hash, "cache_fifo_evict": cache_evicted, "cache_ttl_filter": cache_live_entries, "cache_stats_zero_fill": cache_stats,
}
SQL = {
    "cache_exact_hits": EXACT_SQL, "mmr_select": MMR_SQL,
    "dense_topk": DENSE_SQL + "SELECT query_id, vec_id, round(score, 6) AS score, rank FROM r WHERE rank <= 8", "retrieval_metrics": METRICS_SQL, "semantic_cache_lookup": CACHE_SQL, "bm25_candidates": BM25_SQL, "rrf_fusion": RRF_SQL,
    "metadata_filter": FILTER_SQL, "cache_query_hash": HASH_SQL, "cache_fifo_evict": EVICT_SQL, "cache_ttl_filter": LIVE_SQL, "cache_stats_zero_fill": STATS_SQL,
}
