"""Evaluation, product and streaming queries over the test tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import cited, jaccard, judging_tokens, sentences, video_id, word_count
from lectern.operators.evaluation import completeness, entropy_diversity, latency_stats, size_stats
from lectern.operators.sequence import previous
from lectern.plans.retrieval_queries import JUDGING_SQL, LATEST_CHUNKS
from lectern.session import latest, table

WORDS_SQL = r"len(regexp_extract_all(coalesce({0}, ''), '[^ \t\n\r\f\x0B]+'))"
SOURCES = "items array<struct<citation:int,document:string,page:int,preview:string>>"


def chunk_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("source", F.coalesce("source", F.lit("none")))
    return size_stats(d, "source", word_count(F.col("text")), 40, 900)


SIZE_SQL = f"""
WITH d AS (SELECT coalesce(source, 'none') AS source, {WORDS_SQL.format('text')}::DOUBLE AS s FROM documents)
SELECT source, count(s) AS n, round(avg(s), 6) AS mean, round(coalesce(stddev_samp(s), 0), 6) AS std, min(s) AS least, max(s) AS most, round(quantile_cont(s, 0.05), 6) AS p5, round(quantile_cont(s, 0.95), 6) AS p95,
 round(avg((s > 900)::INT), 6) AS over_rate, round(avg((s < 40)::INT), 6) AS under_rate FROM d GROUP BY source"""

FIELDS = ["summary", "topic", "concept_tags", "chapter_title", "start_sec", "end_sec", "publish_date", "transcript_language", "yt_keywords"]


def metadata_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return completeness(table(spark, sf_dir, "youtube_chunks"), FIELDS)


COMPLETE_SQL = " UNION ALL ".join(
    f"SELECT '{f}' AS field, round(avg(coalesce({c}, false)::INT), 6) AS presence, round(avg(coalesce({c}, false)::INT), 6) < 0.9 AS critical FROM youtube_chunks"
    for f in FIELDS
    for c in [f"len({f}) > 0" if f in ("concept_tags", "yt_keywords") else f"{f} IS NOT NULL" if f.endswith("_sec") else f"{f} <> ''"]
)


def completeness_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: the mean presence over the fields."""
    return metadata_completeness(spark, sf_dir).agg(F.round(F.avg("presence"), 4).alias("completeness"))


def temporal_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per video: chunks and the share that begin more than a second before the end of the one before (by index, then id)."""
    c = latest(table(spark, sf_dir, "youtube_chunks"), ["chunk_id"], ["video_id", "chunk_index", "start_sec", "end_sec"]).where("video_id is not null")
    x = previous(c, "video_id", ["chunk_index", "chunk_id"], 512, F.col("end_sec"), "before")
    late = F.col("start_sec") - F.col("before") < -1
    return x.groupBy("video_id").agg(F.count("*").alias("chunks"), F.round(F.avg(F.coalesce(late, F.lit(False)).cast("double")), 6).alias("overlap_rate"))


OVERLAP_SQL = f"""
WITH x AS (SELECT *, lag(end_sec) OVER (PARTITION BY video_id ORDER BY chunk_index NULLS FIRST, chunk_id) AS before FROM {LATEST_CHUNKS} WHERE video_id IS NOT NULL)
SELECT video_id, count(*) AS chunks, round(avg(coalesce(start_sec - before < -1, false)::INT), 6) AS overlap_rate FROM x GROUP BY video_id"""


def confidence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks by type: mean and least confidence, share under 60, code share, share with warnings, distinct ids."""
    b = table(spark, sf_dir, "ocr_blocks")
    return b.groupBy("block_type").agg(
        F.count("*").alias("blocks"), F.round(F.avg("confidence"), 6).alias("avg_confidence"), F.min("confidence").alias("min_confidence"), F.round(F.avg(F.coalesce(F.col("confidence") < 60, F.lit(False)).cast("double")), 6).alias("low_rate"),
        F.round(F.avg(F.coalesce("is_code", F.lit(False)).cast("double")), 6).alias("code_rate"), F.round(F.avg(F.coalesce(F.size("warnings") > 0, F.lit(False)).cast("double")), 6).alias("warning_rate"),
        F.round(F.count_distinct("block_uid") / F.count("*"), 6).alias("unique_id_rate"))


CONFIDENCE_SQL = """
SELECT block_type, count(*) AS blocks, round(avg(confidence), 6) AS avg_confidence, min(confidence) AS min_confidence, round(avg(coalesce(confidence < 60, false)::INT), 6) AS low_rate,
 round(avg(coalesce(is_code, false)::INT), 6) AS code_rate, round(avg(coalesce(len(warnings) > 0, false)::INT), 6) AS warning_rate, round(count(DISTINCT block_uid) / count(*), 6) AS unique_id_rate FROM ocr_blocks GROUP BY block_type"""


def type_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Handwritten pages by content type: count, mean confidence, equations, diagrams, share that falls below the escalation threshold 0.75."""
    p = latest(table(spark, sf_dir, "handwritten_pages"), ["page_id"], ["content_type", "confidence", "has_equations", "has_diagrams", "ink_quality"])
    rate = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("double")), 6)
    return p.groupBy("content_type").agg(F.count("*").alias("pages"), F.round(F.avg("confidence"), 6).alias("avg_confidence"), rate(F.col("has_equations")).alias("equation_rate"), rate(F.col("has_diagrams")).alias("diagram_rate"), rate(F.col("confidence") < 0.75).alias("escalated_rate"))


TYPE_SQL = """
WITH p AS (SELECT * FROM handwritten_pages QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY ingested_at DESC NULLS LAST) = 1)
SELECT content_type, count(*) AS pages, round(avg(confidence), 6) AS avg_confidence, round(avg(coalesce(has_equations, false)::INT), 6) AS equation_rate, round(avg(coalesce(has_diagrams, false)::INT), 6) AS diagram_rate,
 round(avg(coalesce(confidence < 0.75, false)::INT), 6) AS escalated_rate FROM p GROUP BY content_type"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = latest(table(spark, sf_dir, "chat_history"), ["id"], ["course_id", "message", "response", "sources"], at="created_at")
    return h.withColumn("items", F.coalesce(F.from_json("sources", SOURCES)["items"], F.array().cast("array<struct<citation:int,document:string,page:int,preview:string>>")))


def citation_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per answer: citation numbers, those that its sources have, the share of sources cited."""
    a = _answers(spark, sf_dir)
    known = F.array_distinct(F.filter(F.transform("items", lambda i: i["citation"]), lambda c: c.isNotNull()))
    n, used = cited(F.col("response")), F.array_intersect(cited(F.col("response")), known)
    return a.select("id", F.size(n).alias("cited"), F.size(used).alias("valid"), F.size(known).alias("sources"), F.round(F.when(F.size(known) > 0, F.size(used) / F.size(known)).otherwise(0.0), 6).alias("coverage"))


LATEST_CHAT = "(SELECT * FROM chat_history QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST) = 1)"
CITATION_SQL = f"""
WITH a AS (SELECT id, list_distinct(list_transform(regexp_extract_all(coalesce(response, ''), '\\[(\\d{{1,4}})\\]', 1), lambda x: x::INT)) AS n,
 list_distinct(coalesce(list_transform(try_cast(CASE WHEN json_valid(sources) THEN json_extract(sources, '$.items[*].citation') END AS JSON[]), lambda x: try_cast(x::VARCHAR AS INT)), [])) AS k FROM {LATEST_CHAT})
SELECT id, len(n)::INT AS cited, len(list_intersect(n, k))::INT AS valid, len(k)::INT AS sources, round(CASE WHEN len(k) > 0 THEN len(list_intersect(n, k)) / len(k) ELSE 0 END, 6)::DOUBLE AS coverage FROM a"""


def keyword_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the message's distinct tokens that its answer takes up, and their Jaccard similarity."""
    a = _answers(spark, sf_dir)
    m, r = judging_tokens(F.col("message")), judging_tokens(F.col("response"))
    return a.select("id", F.size(m).alias("keywords"), F.round(F.when(F.size(m) > 0, F.size(F.array_intersect(m, r)) / F.size(m)).otherwise(0.0), 6).alias("recall"), F.round(jaccard(m, r), 6).alias("jaccard"))


RECALL_SQL = f"""
WITH a AS (SELECT id, {JUDGING_SQL.format('message')} AS m, {JUDGING_SQL.format('response')} AS r FROM {LATEST_CHAT})
SELECT id, len(m)::INT AS keywords, round(CASE WHEN len(m) > 0 THEN len(list_intersect(m, r)) / len(m) ELSE 0 END, 6)::DOUBLE AS recall,
 round(CASE WHEN len(m) = 0 OR len(r) = 0 THEN 0 ELSE len(list_intersect(m, r)) / (len(m) + len(r) - len(list_intersect(m, r))) END, 6)::DOUBLE AS jaccard FROM a"""


def hallucination_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of an answer's sentences of four words or more none of whose tokens stands in the previews of its sources."""
    a = _answers(spark, sf_dir).where(F.size("items") > 0)
    context = judging_tokens(F.array_join(F.transform("items", lambda i: F.coalesce(i["preview"], F.lit(""))), " "))
    said = F.filter(sentences(F.col("response")), lambda s: word_count(s) >= 4)
    x = a.select("id", context.alias("c"), said.alias("s")).where(F.size("s") > 0)
    bare = F.size(F.filter("s", lambda s: ~F.arrays_overlap(judging_tokens(s), F.col("c"))))
    return x.select("id", F.size("s").alias("sentences"), bare.alias("unsupported"), F.round(bare / F.size("s"), 6).alias("rate"))


PROXY_SQL = f"""
WITH a AS (SELECT id, coalesce(response, '') AS r, try_cast(CASE WHEN json_valid(sources) THEN json_extract(sources, '$.items[*]') END AS JSON[]) AS items FROM {LATEST_CHAT}),
s AS (SELECT id, {JUDGING_SQL.format("array_to_string(list_transform(items, lambda i: coalesce(i ->> 'preview', '')), ' ')")} AS c, list_filter(string_split(regexp_replace(r, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: len(regexp_extract_all(x, '[^ \\t\\n\\r\\f\\x0B]+')) >= 4) AS s FROM a WHERE len(items) > 0)
SELECT id, len(s)::INT AS sentences, len(list_filter(s, lambda x: NOT list_has_any({JUDGING_SQL.format('x')}, c)))::INT AS unsupported, round(len(list_filter(s, lambda x: NOT list_has_any({JUDGING_SQL.format('x')}, c))) / len(s), 6)::DOUBLE AS rate FROM s WHERE len(s) > 0"""


def source_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy of the document types among the sources of each course's answers."""
    a = _answers(spark, sf_dir).select("course_id", F.explode("items").alias("i"))
    return entropy_diversity(a.select("course_id", F.regexp_extract(F.coalesce("i.document", F.lit("")), r"\.(\w+)$", 1).alias("kind")), "course_id", "kind")


DIVERSITY_SQL = f"""
WITH s AS (SELECT course_id, unnest(try_cast(json_extract(sources, '$.items[*].document') AS JSON[])) AS d FROM {LATEST_CHAT} WHERE json_valid(sources)),
k AS (SELECT course_id, regexp_extract(coalesce(d ->> '$', ''), '\\.(\\w+)$', 1) AS kind FROM s), n AS (SELECT course_id, kind, count(*) AS n FROM k GROUP BY ALL),
t AS (SELECT course_id, sum(n)::BIGINT AS total, count(*) AS kinds FROM n GROUP BY course_id)
SELECT course_id, kinds, total, round(CASE WHEN kinds > 1 THEN sum(-(n / total) * log2(n / total)) / log2(kinds) ELSE 0 END, 6)::DOUBLE AS diversity FROM n JOIN t USING (course_id) GROUP BY course_id, kinds, total"""

LIMIT = {"click": 40.0, "error": 90.0, "purchase": 60.0}


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit = F.lit(50.0)
    for k, v in LIMIT.items():
        limit = F.when(F.col("event_type") == k, v).otherwise(limit)
    return latency_stats(table(spark, sf_dir, "events").where("value is not null"), "event_type", "value", limit)


LATENCY_SQL = """
WITH e AS (SELECT event_type, value, CASE event_type WHEN 'click' THEN 40.0 WHEN 'error' THEN 90.0 WHEN 'purchase' THEN 60.0 ELSE 50.0 END AS l FROM events WHERE value IS NOT NULL)
SELECT event_type AS stage, count(value) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std, min(value) AS least, max(value) AS most, round(quantile_cont(value, 0.5), 6) AS p50,
 round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(avg((value <= l)::INT), 6) AS within, quantile_cont(value, 0.95) <= max(l) AS p95_ok FROM e GROUP BY event_type"""


def overall_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: presence of metadata, keyword recall and latency against their thresholds."""
    c = metadata_completeness(spark, sf_dir).agg(F.avg("presence").alias("completeness"))
    k = keyword_recall(spark, sf_dir).agg(F.avg("recall").alias("recall"))
    e = table(spark, sf_dir, "events").agg(F.percentile("value", F.lit(0.95)).alias("p95"))
    names = {"completeness": (F.col("completeness"), F.col("completeness") >= 0.85), "keyword_recall": (F.col("recall"), F.col("recall") >= 0.5), "latency_p95": (F.col("p95"), F.col("p95") <= 100)}
    one = None
    for name, (value, ok) in names.items():
        part = (c if name == "completeness" else k if name == "keyword_recall" else e).select(F.lit(name).alias("gate"), F.round(value, 6).alias("value"), ok.alias("passed"))
        one = part if one is None else one.unionByName(part)
    return one


HEALTH_SQL = f"""
SELECT 'completeness' AS gate, round(avg(presence), 6) AS value, avg(presence) >= 0.85 AS passed FROM ({COMPLETE_SQL}) UNION ALL SELECT 'keyword_recall', round(avg(recall), 6), avg(recall) >= 0.5 FROM ({RECALL_SQL})
UNION ALL SELECT 'latency_p95', round(quantile_cont(value, 0.95), 6), quantile_cont(value, 0.95) <= 100 FROM events"""


def course_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every course marked with whether anything was asked in it, and by how many users."""
    asked = table(spark, sf_dir, "chat_history").groupBy("course_id").agg(F.count_distinct("user_id").alias("users"))
    c = table(spark, sf_dir, "courses").join(asked, "course_id", "left")
    return c.select("course_id", "course_name", "subject", F.col("users").isNotNull().alias("asked"), F.coalesce("users", F.lit(0)).alias("users"))


CATALOG_SQL = "SELECT c.course_id, course_name, subject, u.users IS NOT NULL AS asked, coalesce(u.users, 0) AS users FROM courses c LEFT JOIN (SELECT course_id, count(DISTINCT user_id) AS users FROM chat_history GROUP BY course_id) u ON u.course_id = c.course_id"


def course_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of each course with their number of questions and the time of the last."""
    h = table(spark, sf_dir, "chat_history").select("id", "user_id", "course_id", "created_at").distinct()
    x = h.groupBy("course_id", "user_id").agg(F.count_distinct("id").alias("questions"), F.max("created_at").alias("last_at"))
    return x.join(table(spark, sf_dir, "courses").select("course_id", "course_name"), "course_id").select("course_name", "user_id", "questions", F.date_format("last_at", "yyyy-MM-dd HH:mm:ss").alias("last_at"))


ROSTER_SQL = "SELECT course_name, user_id, count(DISTINCT id) AS questions, strftime(max(h.created_at), '%Y-%m-%d %H:%M:%S') AS last_at FROM chat_history h JOIN courses c ON c.course_id = h.course_id GROUP BY h.course_id, course_name, user_id"


def course_analytics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per course: lectures, documents, questions, users, mean answer length (one decimal, half to even)."""
    c = table(spark, sf_dir, "courses").select("course_id")
    lectures = table(spark, sf_dir, "lectures").groupBy("course_id").agg(F.count("*").alias("lectures"))
    docs = table(spark, sf_dir, "documents").groupBy("course_id").agg(F.count("*").alias("documents"))
    chat = table(spark, sf_dir, "chat_history").groupBy("course_id").agg(F.count_distinct("id").alias("questions"), F.count_distinct("user_id").alias("users"), F.avg(F.length("response")).alias("chars"))
    x = c.join(lectures, "course_id", "left").join(docs, "course_id", "left").join(chat, "course_id", "left")
    zero = F.lit(0).cast("long")
    return x.select("course_id", *[F.coalesce(n, zero).alias(n) for n in ("lectures", "documents", "questions", "users")], F.round(F.coalesce("chars", F.lit(0.0)), 1).alias("avg_chars"))


ANALYTICS_SQL = """
SELECT c.course_id, coalesce(l.n, 0) AS lectures, coalesce(d.n, 0) AS documents, coalesce(h.q, 0) AS questions, coalesce(h.u, 0) AS users, round(coalesce(h.a, 0), 1) AS avg_chars FROM courses c
LEFT JOIN (SELECT course_id, count(*) AS n FROM lectures GROUP BY 1) l ON l.course_id = c.course_id LEFT JOIN (SELECT course_id, count(*) AS n FROM documents GROUP BY 1) d ON d.course_id = c.course_id
LEFT JOIN (SELECT course_id, count(DISTINCT id) AS q, count(DISTINCT user_id) AS u, avg(length(response)) AS a FROM chat_history GROUP BY 1) h ON h.course_id = c.course_id"""


def recent_chat_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last four exchanges of each user and course, oldest first, answers cut to 500 characters."""
    from lectern.operators.retrieval import keep_newest

    h = latest(table(spark, sf_dir, "chat_history"), ["id"], ["user_id", "course_id", "message", "response", "created_at"], at="created_at")
    top = keep_newest(h, ["user_id", "course_id"], "created_at", "id", 4)
    line = F.concat(F.lit("Q: "), F.coalesce("message", F.lit("")), F.lit("\nA: "), F.substring(F.coalesce("response", F.lit("")), 1, 500))
    by = top.groupBy("user_id", "course_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("created_at", "id", line.alias("t")))), lambda x: x["t"]), "\n").alias("memory"), F.count("*").alias("turns"))
    return by.select("user_id", "course_id", "turns", F.sha2("memory", 256).alias("memory_hash"))


MEMORY_SQL = f"""
WITH t AS (SELECT * FROM {LATEST_CHAT} QUALIFY row_number() OVER (PARTITION BY user_id, course_id ORDER BY created_at DESC, id DESC) <= 4)
SELECT user_id, course_id, count(*) AS turns, sha256(string_agg('Q: ' || coalesce(message, '') || chr(10) || 'A: ' || substring(coalesce(response, ''), 1, 500), chr(10) ORDER BY created_at, id)) AS memory_hash FROM t GROUP BY ALL"""


def history_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = latest(table(spark, sf_dir, "chat_history"), ["id"], ["user_id", "message", "response"], at="created_at")
    return h.where(F.contains(F.lower(F.concat_ws(" ", "message", "response")), F.lit("magnetic field"))).select("id", "user_id")


SEARCH_SQL = f"SELECT id, user_id FROM {LATEST_CHAT} WHERE contains(lower(concat_ws(' ', message, response)), 'magnetic field')"


def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each source table by course, with totals (rollup)."""
    parts = None
    for name in ("documents", "youtube_chunks", "handwritten_pages", "ocr_blocks", "lectures", "chat_history"):
        x = table(spark, sf_dir, name).groupBy("course_id").agg(F.count("*").alias("n")).select(F.lit(name).alias("namespace"), "n")
        parts = x if parts is None else parts.unionByName(x)
    return parts.rollup("namespace").agg(F.sum("n").alias("records")).select(F.coalesce("namespace", F.lit("all")).alias("namespace"), "records")


INDEX_SQL = "SELECT coalesce(namespace, 'all') AS namespace, sum(n)::BIGINT AS records FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS namespace, count(*) AS n FROM {n}" for n in ("documents", "youtube_chunks", "handwritten_pages", "ocr_blocks", "lectures", "chat_history")) + ") GROUP BY ROLLUP (namespace)"


def seed_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of four sources as one wide table: id, source, hash of the whole text, words."""
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("id"), F.lit("documents").alias("source"), "text")
    y = latest(table(spark, sf_dir, "youtube_chunks"), ["chunk_id"], ["raw_text"]).select(F.concat(F.lit("yt_"), F.col("chunk_id")).alias("id"), F.lit("youtube").alias("source"), F.col("raw_text").alias("text"))
    p = latest(table(spark, sf_dir, "handwritten_pages"), ["page_id"], ["transcript"]).select(F.concat(F.lit("hw_"), F.col("page_id").cast("string")).alias("id"), F.lit("handwritten").alias("source"), F.col("transcript").alias("text"))
    o = latest(table(spark, sf_dir, "ocr_blocks"), ["block_uid"], ["raw_text"]).select(F.concat(F.lit("ocr_"), F.col("block_uid").cast("string")).alias("id"), F.lit("image").alias("source"), F.col("raw_text").alias("text"))
    x = d.unionByName(y).unionByName(p).unionByName(o)
    return x.select("id", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_hash"), word_count(F.col("text")).alias("words"))


SEED_SQL = f"""
WITH x AS (SELECT 'doc_' || doc_id AS id, 'documents' AS source, text FROM documents UNION ALL SELECT 'yt_' || chunk_id, 'youtube', raw_text FROM {LATEST_CHUNKS}
UNION ALL SELECT 'hw_' || page_id, 'handwritten', transcript FROM (SELECT * FROM handwritten_pages QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY ingested_at DESC NULLS LAST) = 1)
UNION ALL SELECT 'ocr_' || block_uid, 'image', raw_text FROM (SELECT * FROM ocr_blocks QUALIFY row_number() OVER (PARTITION BY block_uid ORDER BY ingested_at DESC NULLS LAST) = 1))
SELECT id, source, sha256(coalesce(text, '')) AS text_hash, {WORDS_SQL.format('text')}::INT AS words FROM x"""


def video_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "video_meta").select("url", video_id(F.col("url")).alias("extracted"))


VIDEO_SQL = "SELECT url, CASE WHEN regexp_matches(url, '(v=|youtu\\.be/|embed/|shorts/)[A-Za-z0-9_-]{11}') THEN regexp_extract(url, '(?:v=|youtu\\.be/|embed/|shorts/)([A-Za-z0-9_-]{11})', 1) WHEN regexp_matches(url, '^[A-Za-z0-9_-]{11}$') THEN url END AS extracted FROM video_meta"


def sources_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as rows: malformed and empty JSON give none."""
    a = _answers(spark, sf_dir).select("id", F.posexplode("items").alias("pos", "i"))
    return a.select("id", "pos", F.col("i.citation").alias("citation"), F.coalesce("i.document", F.lit("Course material")).alias("document"), F.coalesce(F.col("i.page"), F.lit(-1)).alias("page"), F.substring("i.preview", 1, 320).alias("preview"))


def model_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources taken from a model's text: fenced, with words around it, or plain; how many there are, -1 where no JSON can be read."""
    from lectern.operators.boundary import json_answer

    h = latest(table(spark, sf_dir, "chat_history"), ["id"], ["sources"], at="created_at")
    n = F.length("sources") % 3
    said = F.when(n == 0, F.col("sources")).when(n == 1, F.concat(F.lit("```json\n"), F.col("sources"), F.lit("\n```"))).otherwise(F.concat(F.lit("Here you are: "), F.col("sources"), F.lit(" Anything else?")))
    x = h.withColumn("said", said)
    return x.select("id", F.coalesce(F.size(json_answer("said", SOURCES)["items"]), F.lit(-1)).alias("items"))


MODEL_JSON_SQL = f"SELECT id, coalesce(CASE WHEN json_valid(sources) THEN len(try_cast(json_extract(sources, '$.items') AS JSON[])) END, -1)::INT AS items FROM {LATEST_CHAT}"

JSON_SQL = f"""
WITH s AS (SELECT id, unnest(try_cast(json_extract(sources, '$.items[*]') AS JSON[])) AS i, unnest(range(len(try_cast(json_extract(sources, '$.items[*]') AS JSON[])))) AS pos FROM {LATEST_CHAT} WHERE json_valid(sources))
SELECT id, pos::INT AS pos, (i ->> 'citation')::INT AS citation, coalesce(i ->> 'document', 'Course material') AS document, coalesce((i ->> 'page')::INT, -1) AS page, substring(i ->> 'preview', 1, 320) AS preview FROM s"""


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.streaming.events import windowed_counts

    return windowed_counts(spark, f"{sf_dir}/events.parquet")


STREAM_SQL = "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL"


def stream_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.streaming.events import closed_windows

    return closed_windows(spark, f"{sf_dir}/events.parquet")


CLOSED_SQL = """WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS h, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY ALL)
SELECT strftime(h, '%Y-%m-%d %H:%M:%S') AS hour, event_type, events, total FROM w WHERE h + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"""


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.streaming.events import ingest_upsert

    return ingest_upsert(spark, f"{sf_dir}/youtube_chunks.parquet").select("chunk_id", "video_id", "chunk_index")


INGEST_SQL = f"SELECT chunk_id, video_id, chunk_index FROM {LATEST_CHUNKS}"

QUERIES = {
    "chunk_size_stats": chunk_sizes, "metadata_completeness": metadata_completeness, "temporal_overlap_rate": temporal_overlap, "confidence_stats": confidence_stats, "type_distribution": type_distribution, "citation_coverage": citation_coverage,
    "keyword_recall": keyword_recall, "hallucination_proxy": hallucination_proxy, "source_diversity_entropy": source_diversity, "latency_percentiles_slo": latency_percentiles, "overall_health": overall_health,
    "course_catalog_mark": course_catalog, "roster_join": course_roster, "course_analytics": course_analytics, "recent_chat_memory": recent_chat_memory, "history_search": history_search, "index_stats_rollup": index_stats, "seed_union": seed_union,
    "video_id_extract": video_ids, "source_list": sources_json, "llm_json_extract": model_json, "stream_window_counts": stream_windows, "stream_closed_windows": stream_closed, "stream_ingest_upsert": stream_ingest,
}
SQL = {
    "chunk_size_stats": SIZE_SQL, "metadata_completeness": COMPLETE_SQL, "temporal_overlap_rate": OVERLAP_SQL, "confidence_stats": CONFIDENCE_SQL, "type_distribution": TYPE_SQL, "citation_coverage": CITATION_SQL, "keyword_recall": RECALL_SQL,
    "hallucination_proxy": PROXY_SQL, "overall_health": HEALTH_SQL, "source_diversity_entropy": DIVERSITY_SQL, "latency_percentiles_slo": LATENCY_SQL, "course_catalog_mark": CATALOG_SQL, "roster_join": ROSTER_SQL, "course_analytics": ANALYTICS_SQL, "recent_chat_memory": MEMORY_SQL, "history_search": SEARCH_SQL,
    "index_stats_rollup": INDEX_SQL, "seed_union": SEED_SQL, "video_id_extract": VIDEO_SQL, "source_list": JSON_SQL, "llm_json_extract": MODEL_JSON_SQL, "stream_window_counts": STREAM_SQL, "stream_closed_windows": CLOSED_SQL, "stream_ingest_upsert": INGEST_SQL,
}
