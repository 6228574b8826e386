"""Records of all six kinds in one wide form over the test tables, what is shown of them, and live judging of them; with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import time_label
from lectern.operators.records import KINDS, context_strings, display_text, lexical_text, live_quality, record_citation, widened
from lectern.operators.retrieval import bm25_topk
from lectern.plans.retrieval_queries import BM25_SQL, LATEST_CHUNKS
from lectern.session import latest, table


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest records of six kinds, widened: course documents, exam sheets, lecture segments, video chunks, scanned blocks, handwritten pages."""
    key = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string")).alias("id")
    docs = table(spark, sf_dir, "documents").select(key("doc_", "doc_id"), "text", "course_id", F.col("title").alias("source_file"), F.col("source").alias("section_title"))
    exam = F.coalesce(F.col("section_title") == "exam_sheet", F.lit(False))
    year = F.element_at(F.regexp_extract_all("text", F.lit(r"\b(?:19|20)\d{2}\b"), F.lit(0)), -1)
    marks = F.regexp_extract("text", r"(?i)\[(\d{1,9})\s*(?:marks?|pts?|points?)\]", 1)
    sheets = docs.where(exam).select("*", F.lit("passage").alias("chunk_type"), F.when(marks != "", marks).cast("int").alias("marks_hint"), F.when(F.size(F.regexp_extract_all("text", F.lit(r"\b(?:19|20)\d{2}\b"), F.lit(0))) > 0, year).cast("int").alias("year_hint"))
    lectures = table(spark, sf_dir, "lectures").groupBy("lecture_id").agg(F.max(F.struct("lecture_title", "course_id")).alias("l"))
    speech = latest(table(spark, sf_dir, "segments"), ["lecture_id", "segment_index"], ["text", "speaker", "start_seconds", "end_seconds"]).join(lectures, "lecture_id", "left")
    speech = speech.select(F.concat_ws("#", F.concat(F.lit("seg_"), F.col("lecture_id")), F.col("segment_index").cast("string")).alias("id"), "text", F.col("l.course_id").alias("course_id"), F.col("l.lecture_title").alias("lecture_title"),
                           time_label(F.col("start_seconds")).alias("start_label"), time_label(F.col("end_seconds")).alias("end_label"), F.col("speaker").alias("professor"))
    video = latest(table(spark, sf_dir, "youtube_chunks"), ["chunk_id"], ["raw_text", "course_id", "video_title", "start_label", "end_label", "chapter_title", "deep_link", "topic", "summary"])
    video = video.select(key("yt_", "chunk_id"), F.col("raw_text").alias("text"), "course_id", "video_title", "start_label", "end_label", "chapter_title", "deep_link", "topic", "summary")
    scans = latest(table(spark, sf_dir, "ocr_blocks"), ["block_uid"], ["raw_text", "text", "course_id", "document_id", "page", "block_type"])
    scans = scans.select(key("ocr_", "block_uid"), F.col("raw_text").alias("text"), "course_id", F.col("document_id").alias("source_file"), F.col("page").alias("page_range"), F.col("block_type").alias("image_type"), F.col("text").alias("image_summary"))
    notes = latest(table(spark, sf_dir, "handwritten_pages"), ["page_id"], ["transcript", "course_id", "source_file", "page_number", "topic", "summary", "has_equations", "has_diagrams", "has_tables"])
    notes = notes.select(key("hw_", "page_id"), F.col("transcript").alias("text"), "course_id", "source_file", F.col("page_number").alias("page_range"), "topic", "summary", "has_equations", "has_diagrams", F.col("has_tables").alias("has_table"))
    parts = {"documents": docs.where(~exam), "qna": sheets, "audio": speech, "youtube": video, "image": scans, "handwritten": notes}
    out = None
    for kind in KINDS:
        part = widened(parts[kind], kind)
        out = part if out is None else out.unionByName(part)
    return out


def _time(c: str) -> str:
    s = f"(CASE WHEN {c} IS NULL OR isnan({c}) OR {c} < 0 THEN 0 ELSE floor({c})::BIGINT END)"
    return f"CASE WHEN {s} >= 3600 THEN printf('%02d:%02d:%02d', {s} // 3600, {s} % 3600 // 60, {s} % 60) ELSE printf('%02d:%02d', {s} // 60, {s} % 60) END"


RECORDS_SQL = rf"""rec AS (
SELECT 'doc_' || doc_id AS id, 'documents' AS source_key, text, course_id, title AS source_file, source AS section_title, NULL::VARCHAR AS page_range, NULL::VARCHAR AS topic, NULL::VARCHAR AS summary, NULL::VARCHAR AS keywords, NULL::VARCHAR AS chunk_type, NULL::INT AS year_hint, NULL::INT AS marks_hint,
 NULL::VARCHAR AS image_type, NULL::VARCHAR AS image_summary, NULL::VARCHAR AS lecture_title, NULL::VARCHAR AS start_label, NULL::VARCHAR AS end_label, NULL::VARCHAR AS professor, NULL::VARCHAR AS video_title, NULL::VARCHAR AS chapter_title, NULL::VARCHAR AS deep_link, NULL::BOOLEAN AS has_equations, NULL::BOOLEAN AS has_diagrams
 FROM documents WHERE coalesce(source, '') <> 'exam_sheet'
UNION ALL BY NAME SELECT 'doc_' || doc_id AS id, 'qna' AS source_key, text, course_id, title AS source_file, source AS section_title, 'passage' AS chunk_type, TRY_CAST(nullif(regexp_extract(text, '(?i)\[(\d{{1,9}})\s*(?:marks?|pts?|points?)\]', 1), '') AS INT) AS marks_hint,
 regexp_extract_all(text, '\b(?:19|20)\d{{2}}\b')[-1]::INT AS year_hint FROM documents WHERE source = 'exam_sheet'
UNION ALL BY NAME SELECT concat_ws('#', 'seg_' || s.lecture_id, s.segment_index::VARCHAR) AS id, 'audio' AS source_key, text, l.course_id, l.lecture_title, {_time('start_seconds')} AS start_label, {_time('end_seconds')} AS end_label, speaker AS professor
 FROM (SELECT * FROM segments QUALIFY row_number() OVER (PARTITION BY lecture_id, segment_index ORDER BY ingested_at DESC NULLS LAST) = 1) s LEFT JOIN lectures l ON l.lecture_id = s.lecture_id
UNION ALL BY NAME SELECT 'yt_' || chunk_id AS id, 'youtube' AS source_key, raw_text AS text, course_id, video_title, start_label, end_label, chapter_title, deep_link, topic, summary FROM {LATEST_CHUNKS}
UNION ALL BY NAME SELECT 'ocr_' || block_uid AS id, 'image' AS source_key, raw_text AS text, course_id, document_id AS source_file, page::VARCHAR AS page_range, block_type AS image_type, text AS image_summary FROM (SELECT * FROM ocr_blocks QUALIFY row_number() OVER (PARTITION BY block_uid ORDER BY ingested_at DESC NULLS LAST) = 1)
UNION ALL BY NAME SELECT 'hw_' || page_id AS id, 'handwritten' AS source_key, transcript AS text, course_id, source_file, page_number::VARCHAR AS page_range, topic, summary, has_equations, has_diagrams FROM (SELECT * FROM handwritten_pages QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY ingested_at DESC NULLS LAST) = 1)),
n AS (SELECT *, nullif(source_file, '') AS f, nullif(page_range, '') AS p, coalesce(text, '') AS t FROM rec),
shown AS (SELECT *, array_to_string(list_filter(CASE source_key
  WHEN 'qna' THEN [coalesce(f, 'Q&A Sheet'), 'pp. ' || p, CASE WHEN year_hint <> 0 THEN year_hint::VARCHAR END, CASE WHEN marks_hint > 0 THEN '[' || marks_hint || ' marks]' END]
  WHEN 'image' THEN [coalesce(f, 'Scanned Material'), 'pp. ' || p, array_to_string(list_transform(string_split(replace(nullif(image_type, ''), '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')]
  WHEN 'audio' THEN [coalesce(nullif(lecture_title, ''), f, 'Lecture'), '@ ' || nullif(start_label, '') || '–' || coalesce(end_label, ''), nullif(professor, '')]
  WHEN 'youtube' THEN [coalesce(nullif(video_title, ''), 'YouTube Lecture'), '@ ' || nullif(start_label, ''), CASE WHEN chapter_title NOT IN ('Unknown', '') THEN chapter_title END]
  WHEN 'documents' THEN [coalesce(f, 'Course Document'), 'pp. ' || p, '§ ' || nullif(section_title, '')]
  ELSE [coalesce(f, 'Handwritten Notes'), 'p. ' || p, nullif(topic, '')] END, lambda x: x IS NOT NULL AND trim(x, ' ') <> ''), ' · ') AS citation,
 CASE WHEN source_key = 'qna' THEN 'Q1: ' || t WHEN source_key = 'audio' AND start_label <> '' THEN '[Lecture @ ' || start_label || '–' || coalesce(end_label, '') || ']' || chr(10) || t
  WHEN source_key = 'youtube' AND deep_link <> '' THEN '[YouTube @ ' || coalesce(start_label, '') || ' — ' || deep_link || ']' || chr(10) || t
  WHEN source_key = 'image' AND image_summary <> '' THEN '[Image: ' || coalesce(image_type, '') || ']' || chr(10) || 'Summary: ' || image_summary || chr(10) || chr(10) || 'Extracted text:' || chr(10) || t
  WHEN source_key = 'handwritten' AND has_equations THEN '[has equations] ' || t ELSE t END AS display,
 CASE source_key WHEN 'image' THEN concat_ws(' ', nullif(text, ''), nullif(image_summary, ''), nullif(topic, ''), nullif(keywords, '')) WHEN 'handwritten' THEN concat_ws(' ', nullif(text, ''), nullif(topic, ''), nullif(summary, ''))
  WHEN 'documents' THEN concat_ws(' ', nullif(text, ''), nullif(section_title, ''), nullif(keywords, '')) ELSE t END AS lexical FROM n)"""


def record_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citation of every record in the form of its kind, hashes of its display text and of its lexical text."""
    return records(spark, sf_dir).select("id", "source_key", record_citation().alias("citation"), F.sha2(display_text(), 256).alias("display_hash"), F.sha2(lexical_text(), 256).alias("lexical_hash"))


def record_serialised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as they are returned: display text cut to 800 characters, summaries to 300, missing texts as '', missing hints as -1."""
    r = records(spark, sf_dir)
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return r.select("id", "source_key", F.sha2(F.substring(display_text(), 1, 800), 256).alias("display_hash"), F.substring(F.coalesce("image_summary", F.lit("")), 1, 300).alias("image_summary"), blank("course_id"), blank("source_file"), blank("page_range"), blank("section_title"), blank("topic"), F.coalesce("year_hint", F.lit(-1)).alias("year_hint"), F.coalesce("marks_hint", F.lit(-1)).alias("marks_hint"), F.coalesce("has_equations", F.lit(False)).alias("has_equations"))


def source_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of each kind by course; kinds that have no namespace are passed over (semi join)."""
    names = spark.createDataFrame([(k,) for k in KINDS if k != "audio"] + [("other",)], "source_key string")
    return records(spark, sf_dir).join(F.broadcast(names), "source_key", "left_semi").groupBy("course_id", "source_key").agg(F.count("*").alias("records"))  # seven rows


def live_chunk_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind: records, completeness of the required fields, share of fitting size, richness of words."""
    complete, fits, rich = live_quality()
    x = records(spark, sf_dir).select("source_key", complete.alias("c"), fits.cast("int").alias("f"), F.round(rich * 10000).cast("long").alias("r"))
    return x.groupBy("source_key").agg(F.count("*").alias("total"), F.round(F.avg("c"), 4).alias("completeness"), F.round(F.avg("f"), 4).alias("size_ok"), F.round(F.sum("r") / F.count("*") / 10000, 4).alias("richness"))


LIVE_SQL = "WITH " + RECORDS_SQL + r""",
q AS (SELECT source_key, CASE source_key WHEN 'qna' THEN round(((nullif(chunk_type, '') IS NOT NULL)::INT + (nullif(topic, '') IS NOT NULL)::INT + (f IS NOT NULL)::INT) / 3, 4) WHEN 'image' THEN ((f IS NOT NULL)::INT + (nullif(course_id, '') IS NOT NULL)::INT) / 2
 WHEN 'audio' THEN (nullif(lecture_title, '') IS NOT NULL)::INT WHEN 'youtube' THEN ((nullif(video_title, '') IS NOT NULL)::INT + (nullif(deep_link, '') IS NOT NULL)::INT) / 2
 WHEN 'documents' THEN ((f IS NOT NULL)::INT + (nullif(section_title, '') IS NOT NULL)::INT) / 2 ELSE ((f IS NOT NULL)::INT + (nullif(topic, '') IS NOT NULL)::INT) / 2 END AS c, regexp_extract_all(lower(t), '[^ \t\n\r\f\x0B]+') AS w FROM n)
SELECT source_key, count(*) AS total, round(avg(c), 4)::DOUBLE AS completeness, round(avg((len(w) BETWEEN 15 AND 2000)::INT), 4)::DOUBLE AS size_ok,
 round(sum(round(CASE WHEN len(w) > 0 THEN round(least(1.0, len(list_distinct(w)) / len(w) + 0.1), 4) ELSE 0 END * 10000)::BIGINT) / count(*) / 10000, 4)::DOUBLE AS richness FROM q GROUP BY source_key"""


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("course_id is not null").select(F.col("course_id").alias("grp"), F.col("doc_id").alias("id"), "text", "title")
    return bm25_topk(d, d.where("id % 20 = 0 and title is not null").select(F.col("id").alias("query_id"), "grp", F.col("title").alias("text")), 10)


def context_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each asked title the context of its ranked documents as one numbered string (its hash, and the number of blocks)."""
    r = records(spark, sf_dir).where("source_key in ('documents', 'qna')")
    shown = r.select("id", "source_key", "chunk_type", record_citation().alias("citation"), display_text().alias("display"))
    top = _ranked(spark, sf_dir).select("query_id", "rank", "score", F.concat(F.lit("doc_"), F.col("id").cast("string")).alias("id"), F.lit("bm25").alias("methods"))
    return context_strings(top.join(shown, "id"), "query_id").select("query_id", "chunks", F.sha2("context", 256).alias("context_hash"))


CONTEXT_SQL = BM25_SQL.strip().replace("SELECT query_id, id AS doc_id, score, rank FROM r WHERE rank <= 10", "") + ", " + RECORDS_SQL + """
SELECT query_id, count(*) AS chunks, sha256(chr(10) || string_agg('[' || rank || '] ' || upper(source_key) || ' SOURCE' || chr(10) || '     Citation : ' || citation || chr(10) || '     Type     : ' || coalesce(nullif(chunk_type, ''), '—') || chr(10)
 || '     Score    : ' || score::DECIMAL(12,3)::VARCHAR || chr(10) || '     Methods  : bm25' || chr(10) || chr(10) || trim(display, ' '), chr(10) || '""" + "─" * 65 + """' || chr(10) ORDER BY rank)) AS context_hash
FROM r JOIN shown ON shown.id = 'doc_' || r.id WHERE rank <= 10 GROUP BY query_id"""


def score_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the first of each ranked list stands before its last; 0 for lists of one."""
    return _ranked(spark, sf_dir).groupBy("query_id").agg(F.count("*").alias("found"), F.round(F.max_by("score", -F.col("rank")) - F.max_by("score", F.col("rank")), 6).alias("gap"))


GAP_SQL = BM25_SQL.strip().replace("SELECT query_id, id AS doc_id, score, rank FROM r WHERE rank <= 10", "SELECT query_id, count(*) AS found, round(arg_min(score, rank) - arg_max(score, rank), 6) AS gap FROM r WHERE rank <= 10 GROUP BY query_id")

def source_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of each record told from the names and values of its stored metadata, and whether it is the kind it is kept under."""
    from lectern.functions.labels import infer_source

    r = records(spark, sf_dir)
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
    held = F.array(entry("deep_link", F.col("deep_link")), entry("chunk_type", F.col("chunk_type")), entry("year_hint", F.col("year_hint")), entry("section_title", F.col("section_title")), entry("ink_quality", F.col("has_diagrams")), entry("ocr_confidence", F.col("image_type")))
    meta = F.map_from_entries(F.filter(held, lambda x: x["value"].isNotNull()))
    return r.select("id", infer_source(meta).alias("told"), (infer_source(meta) == F.col("source_key")).alias("same"))


def retrieve_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """End to end over all six namespaces: the titles of documents whose id is divisible by 20 as queries, mode by the kind of document."""
    from lectern.operators.retrieve import retrieve

    r = records(spark, sf_dir)
    r = r.select(F.xxhash64("id").alias("id"), "source_key", "text", "source_file", F.abs(F.hash("id")).alias("position"), "marks_hint", "year_hint", "chunk_type", "has_table")
    d = table(spark, sf_dir, "documents").where("doc_id % 20 = 0 and title is not null")
    mode = F.when(F.col("source") == "exam_sheet", "quiz").when(F.col("source") == "lecture_notes", "summarize").otherwise("ask")
    return retrieve(r, d.select(F.col("doc_id").alias("query_id"), F.col("title").alias("query"), mode.alias("mode")), signals=("exam", "table"))


QUERIES = {
    "retrieve_end_to_end": retrieve_all, "source_inference": source_inference,
    "record_labels": record_labels, "record_serialised": record_serialised, "source_breakdown": source_breakdown, "live_chunk_report": live_chunk_report, "context_string": context_string, "score_gap": score_gap,
}
SQL = {
    "source_inference": "WITH " + RECORDS_SQL + ", t AS (SELECT id, source_key, CASE WHEN deep_link IS NOT NULL THEN 'youtube' WHEN has_diagrams IS NOT NULL THEN 'handwritten' WHEN image_type IS NOT NULL THEN 'image' WHEN chunk_type IN ('single_qa', 'multi_qa', 'passage') OR year_hint IS NOT NULL THEN 'qna' ELSE 'documents' END AS told FROM rec) SELECT id, told, told = source_key AS same FROM t",
    "record_labels": "WITH " + RECORDS_SQL + " SELECT id, source_key, citation, sha256(display) AS display_hash, sha256(lexical) AS lexical_hash FROM shown",
    "record_serialised": "WITH " + RECORDS_SQL + " SELECT id, source_key, sha256(substring(display, 1, 800)) AS display_hash, substring(coalesce(image_summary, ''), 1, 300) AS image_summary, coalesce(course_id, '') AS course_id, coalesce(source_file, '') AS source_file, coalesce(page_range, '') AS page_range, coalesce(section_title, '') AS section_title, coalesce(topic, '') AS topic, coalesce(year_hint, -1) AS year_hint, coalesce(marks_hint, -1) AS marks_hint, coalesce(has_equations, false) AS has_equations FROM shown",
    "source_breakdown": "WITH " + RECORDS_SQL + " SELECT course_id, source_key, count(*) AS records FROM rec WHERE source_key <> 'audio' GROUP BY ALL",
    "live_chunk_report": LIVE_SQL, "context_string": CONTEXT_SQL, "score_gap": GAP_SQL,
}
