"""Classification, labelling, coverage and end-to-end retrieval over the test tables, with SQL twins where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.labels import CODE_MARKS, block_type, citation_label, code_language, infer_source, is_section_title
from lectern.functions.text import time_label, tokens
from lectern.operators.boundary import call_model, hashed_embedding
from lectern.operators.chunking import exam_questions
from lectern.operators.clusters import centroid_clusters, keep_distinct
from lectern.operators.planning import source_boost
from lectern.operators.retrieval import bm25_topk, dense_topk_of_texts, reciprocal_rank_fusion
from lectern.plans.evaluation_queries import LATEST_CHAT
from lectern.plans.retrieval_queries import LATEST_CHUNKS, TOKENS_SQL
from lectern.session import latest, table

LATEST_BLOCKS = "(SELECT * FROM ocr_blocks QUALIFY row_number() OVER (PARTITION BY block_uid ORDER BY ingested_at DESC NULLS LAST) = 1)"


def _blocks(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return latest(table(spark, sf_dir, "ocr_blocks"), ["block_uid"], list(columns))


def code_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir, "raw_text", "is_code").where("is_code").select("block_uid", code_language(F.col("raw_text")).alias("language"))


def _count(pattern: str) -> str:
    return f"len(regexp_extract_all(coalesce(raw_text, ''), '(?mi){pattern}'))"


CODE_SQL = (
    "WITH s AS (SELECT block_uid, " + ", ".join("(" + " + ".join(_count(p) for p in ps) + f") AS {name}_n" for name, ps in CODE_MARKS.items()) + f" FROM {LATEST_BLOCKS} WHERE is_code), "
    "m AS (SELECT *, greatest(" + ", ".join(f"{n}_n" for n in CODE_MARKS) + ") AS best FROM s) SELECT block_uid, CASE WHEN best < 2 THEN 'unknown' " + " ".join(f"WHEN {n}_n = best THEN '{n}'" for n in CODE_MARKS) + " END AS language FROM m"
)


def block_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _blocks(spark, sf_dir, "raw_text", "is_code", "bbox")
    return b.select("block_uid", block_type(F.col("raw_text"), F.col("is_code"), F.col("bbox.y"), F.lit(1400.0)).alias("kind"), is_section_title(F.substring_index("raw_text", "\n", 1)).alias("is_title"))


TYPE_SQL = rf"""
WITH b AS (SELECT block_uid, trim(coalesce(raw_text, ''), ' ') AS t, coalesce(is_code, false) AS c, bbox.y / 1400.0 AS p, trim(split_part(raw_text, chr(10), 1), ' ') AS l FROM {LATEST_BLOCKS})
SELECT block_uid, CASE WHEN t = '' THEN 'unknown' WHEN c THEN 'code' WHEN len(regexp_extract_all(t, '[=+∑∫√≤≥^]')) >= 2 THEN 'formula' WHEN regexp_matches(t, '^(?:[-*•]|\d{{1,3}}[.)])\s+\S') THEN 'list_item'
 WHEN p < 0.15 AND length(t) <= 80 AND NOT regexp_matches(t, '[.]$') THEN 'heading' WHEN p > 0.85 AND length(t) <= 120 THEN 'caption' ELSE 'paragraph' END AS kind,
 coalesce(length(l) > 0 AND length(l) <= 110 AND NOT regexp_matches(l, '[.,;]$') AND (regexp_matches(l, '^(?:\d+(?:\.\d+)*[.)]?\s+\S|(?i:chapter|unit|section|part|lecture|lesson|module|topic|slide)\b)')
  OR (len(string_split_regex(l, '\s+')) <= 10 AND ((upper(l) = l AND regexp_matches(l, '[A-Z]')) OR (regexp_matches(l, '[A-Z]') AND NOT regexp_matches(l, '(?:^|[^A-Za-z])[a-z]|[A-Za-z][A-Z]'))))), false) AS is_title FROM b"""


def citation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = latest(table(spark, sf_dir, "youtube_chunks"), ["chunk_id"], ["video_title", "chapter_title", "start_sec"])
    return c.select("chunk_id", citation_label(F.lit("Video"), F.col("video_title"), F.col("chapter_title"), time_label(F.col("start_sec"))).alias("label"))


LABEL_SQL = f"""
WITH c AS (SELECT *, CASE WHEN start_sec IS NULL OR isnan(start_sec) OR start_sec < 0 THEN 0 ELSE floor(start_sec)::BIGINT END AS s FROM {LATEST_CHUNKS})
SELECT chunk_id, array_to_string(list_filter(['Video', video_title, chapter_title, CASE WHEN s >= 3600 THEN printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%02d:%02d', s // 60, s % 60) END],
 lambda x: x IS NOT NULL AND trim(x, ' ') <> ''), ' · ') AS label FROM c"""


def boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = latest(table(spark, sf_dir, "handwritten_pages"), ["page_id"], ["has_equations", "content_type", "confidence"])
    b = source_boost("handwritten", ("equations",))
    return p.select("page_id", F.round(b, 6).alias("boost"), infer_source(F.create_map(F.lit("ink_quality"), F.lit("x"), F.lit("page_number"), F.lit("1"))).alias("source"))


BOOST_SQL = """
SELECT page_id, round((CASE WHEN content_type = 'equation' THEN 1.08::DOUBLE ELSE 1 END) * (CASE WHEN confidence < 0.6 THEN 0.85::DOUBLE ELSE 1 END) * (CASE WHEN has_equations THEN 1.15::DOUBLE ELSE 1 END), 6) AS boost, 'handwritten' AS source
FROM (SELECT * FROM handwritten_pages QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY ingested_at DESC NULLS LAST) = 1)"""


def topic_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of each lecture, covered if at least half of their words stand in what is asked in the course."""
    topics = table(spark, sf_dir, "lectures").select("lecture_id", "course_id", F.explode("topics").alias("topic")).withColumn("word", F.explode(F.array_distinct(tokens(F.col("topic")))))
    asked = table(spark, sf_dir, "chat_history").select("course_id", F.explode(F.array_distinct(tokens(F.col("message")))).alias("word")).distinct().withColumn("hit", F.lit(1))
    by = topics.join(asked, ["course_id", "word"], "left").groupBy("lecture_id", "topic").agg(F.count("*").alias("words"), F.coalesce(F.sum("hit"), F.lit(0)).alias("found"))
    return by.select("lecture_id", "topic", "words", "found", (F.col("found") * 2 >= F.col("words")).alias("covered"))


COVERAGE_SQL = f"""
WITH t AS (SELECT DISTINCT lecture_id, course_id, topic, unnest(list_distinct({TOKENS_SQL.format('topic')})) AS word FROM (SELECT lecture_id, course_id, unnest(topics) AS topic FROM lectures)),
a AS (SELECT DISTINCT course_id, unnest({TOKENS_SQL.format('message')}) AS word FROM chat_history)
SELECT lecture_id, topic, count(*) AS words, count(a.word) AS found, count(a.word) * 2 >= count(*) AS covered FROM t LEFT JOIN a ON a.course_id = t.course_id AND a.word = t.word GROUP BY lecture_id, topic"""


def mode_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance (L1, at most 1) between each course's mix of question modes and that of all courses."""
    h = latest(table(spark, sf_dir, "chat_history"), ["id"], ["course_id", "message"], at="created_at")
    mode = F.when(F.col("message").startswith("Summary"), "summarize").when(F.col("message").startswith("Flashcards"), "quiz").otherwise("ask")
    n = h.groupBy("course_id", mode.alias("mode")).agg(F.count("*").alias("n"))
    modes = ["ask", "quiz", "summarize"]
    wide = n.groupBy("course_id").agg(*[F.coalesce(F.sum(F.when(F.col("mode") == m, F.col("n"))), F.lit(0)).alias(m) for m in modes])
    total = n.agg(*[F.coalesce(F.sum(F.when(F.col("mode") == m, F.col("n"))), F.lit(0)).alias(f"all_{m}") for m in modes])
    x = wide.join(F.broadcast(total))  # one row
    own, everyone = sum((F.col(m) for m in modes[1:]), F.col(modes[0])), sum((F.col(f"all_{m}") for m in modes[1:]), F.col(f"all_{modes[0]}"))
    distance = sum((F.abs(F.col(m) / own - F.col(f"all_{m}") / everyone) for m in modes[1:]), F.abs(F.col(modes[0]) / own - F.col(f"all_{modes[0]}") / everyone))
    return x.select("course_id", *modes, F.round(F.least(distance, F.lit(1.0)), 6).alias("distance"))


MODE_SQL = f"""
WITH h AS (SELECT course_id, CASE WHEN message LIKE 'Summary%' THEN 'summarize' WHEN message LIKE 'Flashcards%' THEN 'quiz' ELSE 'ask' END AS mode FROM {LATEST_CHAT}),
c AS (SELECT course_id, count(*) FILTER (mode = 'ask') AS ask, count(*) FILTER (mode = 'quiz') AS quiz, count(*) FILTER (mode = 'summarize') AS "summarize" FROM h GROUP BY course_id),
t AS (SELECT sum(ask) AS a, sum(quiz) AS q, sum("summarize") AS s FROM c)
SELECT course_id, ask, quiz, "summarize", round(least(abs(ask / (ask + quiz + "summarize") - a / (a + q + s)) + abs(quiz / (ask + quiz + "summarize") - q / (a + q + s)) + abs("summarize" / (ask + quiz + "summarize") - s / (a + q + s)), 1.0), 6)::DOUBLE AS distance FROM c, t"""


def question_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of each exam sheet clustered in order by their embeddings (stand-in model)."""
    d = table(spark, sf_dir, "documents").where("source = 'exam_sheet'").select("doc_id", F.transform(exam_questions(F.col("text")), lambda q: q["body"]).alias("bodies"))
    return centroid_clusters(d, "doc_id", "bodies").withColumnRenamed("id", "doc_id")


def assembled_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of questions as chunks: questions, mean marks (whole), latest year, sub-parts, estimated tokens."""
    d = table(spark, sf_dir, "documents").where("source = 'exam_sheet'")
    q = d.select("doc_id", F.posexplode(exam_questions(F.col("text"))).alias("position", "q"))
    x = q.join(question_clusters(spark, sf_dir), ["doc_id", "position"])
    marked = F.when(F.col("q.marks") >= 0, F.col("q.marks"))
    return x.groupBy("doc_id", "cluster").agg(F.count("*").alias("questions"), F.coalesce(F.floor(F.avg(marked)).cast("int"), F.lit(-1)).alias("marks"), F.max("q.year").alias("year"), F.max("q.sub_parts").alias("sub_parts"), F.floor(F.sum(F.length("q.body")) / 4).alias("tokens"))


def distinct_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each sheet's questions, those not near a question kept before (Jaccard below 0.72)."""
    d = table(spark, sf_dir, "documents").where("source = 'exam_sheet'").select("doc_id", F.transform(exam_questions(F.col("text")), lambda q: q["body"]).alias("b"))
    return d.select("doc_id", F.size("b").alias("questions"), F.size(keep_distinct(F.col("b"), tokens)).alias("kept"))


def _jaccard_sql(a: str, b: str) -> str:
    x, y = f"list_distinct({TOKENS_SQL.format(a)})", f"list_distinct({TOKENS_SQL.format(b)})"
    return f"(CASE WHEN len({x}) = 0 OR len({y}) = 0 THEN 0 ELSE len(list_intersect({x}, {y})) / (len({x}) + len({y}) - len(list_intersect({x}, {y}))) END)"


DISTINCT_SQL = rf"""
WITH p AS (SELECT doc_id, list_filter(string_split_regex(chr(10) || coalesce(text, ''), '
(?:Q|Question )'), lambda x: regexp_matches(x, '^\d{{1,3}}[.:)]\s')) AS p FROM documents WHERE source = 'exam_sheet'),
b AS (SELECT doc_id, list_transform(p, lambda x: regexp_replace(regexp_replace(regexp_replace(x, '^\d{{1,3}}[.:)]\s', ''), '\s*\[\d{{1,3}} marks?\]', '', 'g'), '^\s+|\s+$', '', 'g')) AS b FROM p)
SELECT doc_id, len(b)::INT AS questions, coalesce(len(list_reduce(list_transform(b, lambda q: [q]), lambda k, x: CASE WHEN len(list_filter(k, lambda y: {_jaccard_sql('y', 'x[1]')} >= 0.72)) > 0 THEN k ELSE list_append(k, x[1]) END, []::VARCHAR[])), 0)::INT AS kept FROM b"""


def hybrid_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """End to end: titles of documents whose id is divisible by 20 as queries; dense (stand-in embedding) and BM25 lists of all documents of the course, fused."""
    d = table(spark, sf_dir, "documents").where("course_id is not null").select("doc_id", "course_id", "title", "text")
    asked = d.where("doc_id % 20 = 0 and title is not null")
    embed = lambda df: call_model(df, "text", hashed_embedding, "array<double>", "vector")
    vectors = embed(d.select(F.col("doc_id").alias("id"), "text")).select("id", "vector")
    dense = dense_topk_of_texts(vectors, asked.select(F.col("doc_id").alias("query_id"), F.col("title").alias("text")), 20, embed, count=d.count())
    dense = dense.select("query_id", "id", F.lit("dense").alias("method"), "rank", F.lit(1.0).alias("weight"))
    lexical = bm25_topk(d.select(F.col("course_id").alias("grp"), F.col("doc_id").alias("id"), "text"), asked.select(F.col("doc_id").alias("query_id"), F.col("course_id").alias("grp"), F.col("title").alias("text")), 20)
    lexical = lexical.select("query_id", "id", F.lit("bm25").alias("method"), "rank", F.lit(1.2).alias("weight"))
    return reciprocal_rank_fusion(dense.unionByName(lexical), 8)


def planned_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rule planner would spend on each source, over all questions: queries, candidates, mean weight."""
    from lectern.operators.planning import plan_budgets

    h = latest(table(spark, sf_dir, "chat_history"), ["id"], ["message"], at="created_at")
    mode = F.when(F.col("message").startswith("Summary"), "summarize").when(F.col("message").startswith("Flashcards"), "quiz").otherwise("ask")
    return plan_budgets(h.select(F.col("id").alias("query_id"), F.col("message").alias("query"), mode.alias("mode"))).groupBy("category", "source").agg(
        F.count("*").alias("queries"), F.sum("dense_k").alias("candidates"), F.round(F.sum(F.round(F.col("priority_weight") * 1000).cast("long")) / F.count("*") / 1000, 6).alias("mean_weight"))


def _plan_sql() -> str:
    from lectern.operators.planning import _rows

    rules = ", ".join(f"('{m}', '{c}', '{s}', {k}, {w})" for m, c, s, k, w, _ in _rows())
    return f"""
WITH r(mode, category, source, dense_k, w) AS (VALUES {rules}),
q AS (SELECT CASE WHEN message LIKE 'Summary%' THEN 'summarize' WHEN message LIKE 'Flashcards%' THEN 'quiz' ELSE 'ask' END AS mode, lower(coalesce(message, '')) AS m FROM {LATEST_CHAT}),
c AS (SELECT mode, CASE WHEN regexp_matches(m, '\\b(?:difference|compare|versus|vs)\\b') THEN 'comparison' WHEN regexp_matches(m, '\\b(?:diagram|figure|graph|plot|picture)\\b') THEN 'visual_or_diagram'
 WHEN regexp_matches(m, '\\b(?:derive|prove|solve|calculate)\\b') THEN 'problem_or_derivation' WHEN regexp_matches(m, '\\bexample\\b') THEN 'worked_example' WHEN regexp_matches(m, '\\b(?:steps?|procedure|how to)\\b') THEN 'procedural_steps' ELSE 'general' END AS category FROM q)
SELECT category, source, count(*) AS queries, sum(dense_k)::BIGINT AS candidates, round(sum(round(w::DOUBLE * 1000)::BIGINT) / count(*) / 1000, 6)::DOUBLE AS mean_weight FROM c JOIN r USING (mode, category) GROUP BY category, source"""


QUERIES = {
    "plan_budgets": planned_budgets, "code_language_score": code_languages, "block_type": block_types, "citation_label": citation_labels, "metadata_boost": boosts, "topic_coverage": topic_coverage, "mode_adaptation": mode_mix,
    "qna_cluster": question_clusters, "qna_assemble": assembled_clusters, "subquery_dedup_greedy": distinct_questions, "hybrid_retrieve": hybrid_documents,
}
SQL = {"plan_budgets": _plan_sql(), "code_language_score": CODE_SQL, "block_type": TYPE_SQL, "citation_label": LABEL_SQL, "metadata_boost": BOOST_SQL, "topic_coverage": COVERAGE_SQL, "mode_adaptation": MODE_SQL, "subquery_dedup_greedy": DISTINCT_SQL}
