"""Chunking and metadata queries over the test tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import normalise_ocr, slug, time_label, token_estimate, tokens, word_count
from lectern.operators import chunking as C
from lectern.operators.sequence import ordinals, previous, sliding_windows
from lectern.plans.retrieval_queries import LATEST_CHUNKS, STOP_SQL
from lectern.session import exact_mean, latest, table


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = latest(table(spark, sf_dir, "segments"), ["lecture_id", "segment_index"], ["start_seconds", "end_seconds", "text", "confidence", "is_unclear"])
    return ordinals(s, "lecture_id", ["segment_index"], 512)


LATEST_SEGMENTS = """(SELECT *, row_number() OVER (PARTITION BY lecture_id ORDER BY segment_index) - 1 AS ordinal FROM
 (SELECT * FROM segments QUALIFY row_number() OVER (PARTITION BY lecture_id, segment_index ORDER BY ingested_at DESC NULLS LAST) = 1))"""


def sliding_window_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of six segments overlapping by two: extent, words, mean confidence, whether any is unclear."""
    w = sliding_windows(_segments(spark, sf_dir), "lecture_id", "ordinal", 6, 2)
    return w.groupBy("lecture_id", "window_index").agg(
        F.count("*").alias("segments"), F.min("ordinal").alias("first_ordinal"), F.max("ordinal").alias("last_ordinal"), F.min("start_seconds").alias("start_seconds"), F.sum(word_count(F.col("text"))).alias("words"),
        exact_mean("confidence").alias("avg_confidence"), F.min("confidence").alias("min_confidence"), F.max("is_unclear").alias("has_unclear"))


WINDOW_SQL = f"""
WITH s AS (SELECT *, max(ordinal) OVER (PARTITION BY lecture_id) AS most FROM {LATEST_SEGMENTS}),
w AS (SELECT s.*, unnest(range(greatest(ceil((ordinal - 5) / 4.0), 0)::BIGINT, least(floor(ordinal / 4.0), ceil(greatest(most - 5, 0) / 4.0))::BIGINT + 1)) AS window_index FROM s)
SELECT lecture_id, window_index, count(*) AS segments, min(ordinal) AS first_ordinal, max(ordinal) AS last_ordinal, min(start_seconds) AS start_seconds,
       sum(len(regexp_extract_all(text, '[^\\s]+')))::BIGINT AS words, round(sum(round(confidence * 1000000)::BIGINT) / count(confidence) / 1000000, 6) AS avg_confidence, min(confidence) AS min_confidence, bool_or(is_unclear) AS has_unclear
FROM w GROUP BY lecture_id, window_index"""


def lecture_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-lecture chunk: segments, covered share of the duration, mean confidence, and the text of summary, topics and key terms."""
    s = _segments(spark, sf_dir)
    by = s.groupBy("lecture_id").agg(F.count("*").alias("segments"), F.max("end_seconds").alias("end_seconds"), exact_mean("confidence").alias("avg_confidence"))
    x = by.join(table(spark, sf_dir, "lectures"), "lecture_id")
    bullets = F.array_join(F.transform(F.coalesce("topics", F.array().cast("array<string>")), lambda t: F.concat(F.lit("- "), t)), "\n")
    text = F.concat_ws("\n", "summary", bullets, F.concat(F.lit("Key terms: "), F.array_join(F.coalesce("searchable_keywords", F.array().cast("array<string>")), ", ")))
    return x.select("lecture_id", "segments", "avg_confidence", F.when((F.col("duration_seconds") > 0) & ~F.isnan("duration_seconds") & F.col("end_seconds").isNotNull(), F.round(F.least(F.col("end_seconds") / F.col("duration_seconds"), F.lit(1.0)), 6)).alias("coverage"), text.alias("text"))


SUMMARY_SQL = f"""
WITH b AS (SELECT lecture_id, count(*) AS segments, max(end_seconds) AS end_seconds, round(sum(round(confidence * 1000000)::BIGINT) / count(confidence) / 1000000, 6) AS avg_confidence FROM {LATEST_SEGMENTS} GROUP BY lecture_id)
SELECT lecture_id, segments, avg_confidence, CASE WHEN duration_seconds > 0 AND NOT isnan(duration_seconds) AND end_seconds IS NOT NULL THEN round(least(end_seconds / duration_seconds, 1.0), 6) END AS coverage,
       concat_ws(chr(10), summary, array_to_string(list_transform(coalesce(topics, []), lambda t: '- ' || t), chr(10)), 'Key terms: ' || array_to_string(coalesce(searchable_keywords, []), ', ')) AS text
FROM b JOIN lectures USING (lecture_id)"""


def concept_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _segments(spark, sf_dir).withColumn("salt", F.pmod(F.hash("segment_index"), F.lit(16)))
    # salted and merged, so neither a long recording nor a large table of lectures is one task's or every task's burden
    lectures = table(spark, sf_dir, "lectures").select("lecture_id", "topics", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt"))
    return C.concept_boundaries(s.join(lectures.hint("merge"), ["lecture_id", "salt"]), "lecture_id", "ordinal", "text", "topics").withColumnRenamed("key", "lecture_id")


CONCEPT_SQL = f"""
WITH RECURSIVE s AS (SELECT lecture_id, ordinal, string_agg(lower(coalesce(text, '')), ' ') OVER (PARTITION BY lecture_id ORDER BY ordinal ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS ahead FROM {LATEST_SEGMENTS}),
c AS (SELECT lecture_id, ordinal, coalesce(topics, []) AS names, list_transform(coalesce(topics, []), lambda t: (length(ahead) - length(replace(ahead, lower(t), ''))) // length(t)) AS n FROM s JOIN lectures USING (lecture_id)),
w AS MATERIALIZED (SELECT lecture_id, ordinal, names, CASE WHEN len(n) > 0 AND list_max(n) > 0 THEN list_position(n, list_max(n)) ELSE 0 END AS seen FROM c),
f AS (SELECT lecture_id, ordinal, 1 AS since, seen AS topic, true AS starts FROM w WHERE ordinal = 0
 UNION ALL SELECT lecture_id, ordinal, CASE WHEN cut THEN 1 ELSE since + 1 END, CASE WHEN cut THEN seen ELSE topic END, cut FROM
 (SELECT w.lecture_id, w.ordinal, since, topic, seen, (len(names) = 0 AND since >= 4) OR since >= 12 OR (since >= 4 AND seen > 0 AND seen <> topic) AS cut FROM f JOIN w ON w.lecture_id = f.lecture_id AND w.ordinal = f.ordinal + 1)),
r AS (SELECT lecture_id, ordinal AS start_ordinal, coalesce(lead(ordinal) OVER (PARTITION BY lecture_id ORDER BY ordinal) - 1, (SELECT max(ordinal) FROM w WHERE w.lecture_id = f.lecture_id)) AS end_ordinal, topic FROM f WHERE starts)
SELECT r.lecture_id, start_ordinal, end_ordinal, coalesce(names[topic], '') AS topic FROM r JOIN w ON w.lecture_id = r.lecture_id AND w.ordinal = r.start_ordinal"""


def _chunks(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return latest(table(spark, sf_dir, "youtube_chunks"), ["chunk_id"], list(columns))


def asof_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chapter of its video that each chunk starts in; before the first chapter the first; 'Unknown' without chapters."""
    c = _chunks(spark, sf_dir, "video_id", "start_sec").where("start_sec is not null and not isnan(start_sec)").withColumn("salt", F.pmod(F.hash("chunk_id"), F.lit(16)))
    v = table(spark, sf_dir, "video_meta").select("video_id", "chapters", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt"))
    hit = C.asof_last(F.col("chapters"), F.col("start_sec"), "start_sec")
    return c.join(v, ["video_id", "salt"]).select("chunk_id", F.coalesce(hit["title"], F.lit("Unknown")).alias("chapter"))


CHAPTER_SQL = f"""
WITH c AS (SELECT chunk_id, video_id, start_sec FROM {LATEST_CHUNKS} WHERE start_sec IS NOT NULL AND NOT isnan(start_sec)),
h AS (SELECT video_id, x.title AS title, x.start_sec AS pos FROM (SELECT video_id, unnest(chapters) AS x FROM video_meta) WHERE x.start_sec IS NOT NULL),
f AS (SELECT video_id, arg_min(title, pos) AS title FROM h GROUP BY video_id)
SELECT c.chunk_id, coalesce((SELECT arg_max(h.title, h.pos) FROM h WHERE h.video_id = c.video_id AND h.pos <= c.start_sec), f.title, 'Unknown') AS chapter
FROM c JOIN video_meta v USING (video_id) LEFT JOIN f USING (video_id)"""


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.pseudo_pages(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", 5).select("doc_id", "page_no", "page_lines", F.sha2("page_text", 256).alias("page_hash"))


PAGES_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: trim(s, ' ') <> '') AS l FROM documents),
p AS (SELECT doc_id, l, unnest(range(1, greatest(ceil(len(l) / 5.0), 1)::BIGINT + 1)) AS page_no FROM d)
SELECT doc_id, page_no::INT AS page_no, len(l[(page_no - 1) * 5 + 1 : page_no * 5])::INT AS page_lines, sha256(array_to_string(l[(page_no - 1) * 5 + 1 : page_no * 5], chr(10))) AS page_hash FROM p"""


def document_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.word_windows(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", 120, 20).select("doc_id", "window_index", "window_words", F.sha2("window_text", 256).alias("window_hash"))


DOC_WINDOW_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f\x0B]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(0, ceil(greatest(len(w) - 120, 0) / 100.0)::BIGINT + 1)) AS i FROM d WHERE len(w) > 0)
SELECT doc_id, i::INT AS window_index, len(w[i * 100 + 1 : i * 100 + 120])::INT AS window_words, sha256(array_to_string(w[i * 100 + 1 : i * 100 + 120], ' ')) AS window_hash FROM p"""


def keyword_top12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve most frequent words of four letters or more of each document, ties to the earlier one, joined by commas."""
    from pyspark.sql import Window

    words = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tokens(F.col("text"), 4, letters_only=True)).alias("at", "term"))
    n = words.groupBy("doc_id", "term").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    top = n.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("n").desc(), "at"))).where("r <= 12")
    return top.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: x["term"]), ", ").alias("keywords"))


KEYWORD_SQL = f"""
WITH d AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{{4,}}'), lambda t: t NOT IN ({STOP_SQL})) AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM d),
n AS (SELECT doc_id, term, count(*) AS n, min(pos) AS pos FROM t GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) AS r FROM n)
SELECT doc_id, string_agg(term, ', ' ORDER BY r) AS keywords FROM r WHERE r <= 12 GROUP BY doc_id"""


def exact_text_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.groupBy(F.sha2(F.trim("text"), 256).alias("text_hash")).agg(F.min("doc_id").alias("kept_id"), F.count("*").alias("copies"))


DEDUP_SQL = "SELECT sha256(trim(text, ' ')) AS text_hash, min(doc_id) AS kept_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY ALL"


def prev_next_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk with the one before it in its video ('' for the first), by chunk_index, then id."""
    c = _chunks(spark, sf_dir, "video_id", "chunk_index").where("video_id is not null")
    x = previous(c, "video_id", ["chunk_index", "chunk_id"], 512, F.col("chunk_id"), "prev_chunk_id")
    return x.select("chunk_id", F.coalesce("prev_chunk_id", F.lit("")).alias("prev_chunk_id"))


LINK_SQL = f"SELECT chunk_id, coalesce(lag(chunk_id) OVER (PARTITION BY video_id ORDER BY chunk_index NULLS FIRST, chunk_id), '') AS prev_chunk_id FROM {LATEST_CHUNKS} WHERE video_id IS NOT NULL"


def youtube_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector records of video chunks: label, deep link, capped text, word and token counts, index name."""
    c = _chunks(spark, sf_dir, "video_id", "course_name", "topic", "summary", "raw_text", "start_sec")
    sec = F.when(F.col("start_sec").isNull() | F.isnan("start_sec") | (F.col("start_sec") < 0), F.lit(0)).otherwise(F.floor("start_sec")).cast("long")
    return c.select(
        "chunk_id", time_label(F.col("start_sec")).alias("start_label"), F.concat(F.lit("https://video.example/w?v="), F.col("video_id"), F.lit("&t="), sec.cast("string"), F.lit("s")).alias("deep_link"),
        F.sha2(F.substring(F.concat_ws("\n", F.nullif(F.col("topic"), F.lit("")), F.nullif(F.col("summary"), F.lit("")), F.col("raw_text")), 1, 8000), 256).alias("embed_hash"),
        word_count(F.col("raw_text")).alias("words"), token_estimate(F.col("raw_text")).alias("tokens"), slug(F.col("course_name"), "course").alias("index_name"))


RECORD_SQL = f"""
WITH c AS (SELECT *, CASE WHEN start_sec IS NULL OR isnan(start_sec) OR start_sec < 0 THEN 0 ELSE floor(start_sec)::BIGINT END AS s, len(regexp_extract_all(raw_text, '[^ \\t\\n\\r\\f\\x0B]+')) AS n,
 substring(regexp_replace(regexp_replace(lower(course_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 29) AS g FROM {LATEST_CHUNKS})
SELECT chunk_id, CASE WHEN s >= 3600 THEN printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%02d:%02d', s // 60, s % 60) END AS start_label,
 'https://video.example/w?v=' || video_id || '&t=' || s || 's' AS deep_link, sha256(substring(concat_ws(chr(10), nullif(topic, ''), nullif(summary, ''), raw_text), 1, 8000)) AS embed_hash,
 n::INT AS words, greatest(1, floor(n * 1.3))::INT AS tokens, 'course-' || regexp_replace(g, '-+$', '') || '-' || substring(sha256(course_name), 1, 8) AS index_name FROM c"""


def exam_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("source = 'exam_sheet'")
    return d.select("doc_id", F.explode(C.exam_questions(F.col("text"))).alias("q")).select("doc_id", F.col("q.number").alias("number"), F.col("q.marks").alias("marks"), F.sha2("q.body", 256).alias("body_hash"))


EXAM_SQL = r"""
WITH p AS (SELECT doc_id, unnest(string_split_regex(chr(10) || text, '\nQ')[2:]) AS p FROM documents WHERE source = 'exam_sheet'),
q AS (SELECT doc_id, p FROM p WHERE regexp_matches(p, '^\d{1,3}[.:)]\s'))
SELECT doc_id, regexp_extract(p, '^(\d{1,3})', 1)::INT AS number, CASE WHEN regexp_matches(p, '\[\d{1,3} marks?\]') THEN regexp_extract(p, '\[(\d{1,3}) marks?\]', 1)::INT ELSE -1 END AS marks,
 sha256(trim(regexp_replace(regexp_replace(p, '^\d{1,3}[.:)]\s', ''), '\s*\[\d{1,3} marks?\]', '', 'g'), ' ' || chr(10))) AS body_hash FROM q"""


def _fold(name: str, fold):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if name == "pages":
            return C.fold_chunks(latest(table(spark, sf_dir, "handwritten_pages"), ["page_id"], ["structured_markdown"]), "page_id", "structured_markdown", fold)
        return C.fold_chunks(table(spark, sf_dir, "documents"), "doc_id", "text", fold)

    return run


def ocr_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = latest(table(spark, sf_dir, "ocr_blocks"), ["block_uid"], ["raw_text"])
    t = normalise_ocr(F.col("raw_text"))
    return b.select("block_uid", F.length(t).alias("chars"), F.sha2(t, 256).alias("text_hash"))


OCR_SQL = r"""
WITH b AS (SELECT block_uid, regexp_replace(coalesce(raw_text, ''), '\r\n?', chr(10), 'g') AS t FROM (SELECT * FROM ocr_blocks QUALIFY row_number() OVER (PARTITION BY block_uid ORDER BY ingested_at DESC NULLS LAST) = 1)),
n AS (SELECT block_uid, trim(regexp_replace(regexp_replace(regexp_replace(t, '([A-Za-z])-\n([a-z])', '\1\2', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ') AS t FROM b)
SELECT block_uid, length(t)::INT AS chars, sha256(t) AS text_hash FROM n"""


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a page in reading order (bbox y, x), code wrapped with its language; mean confidence and a warning under 60."""
    b = latest(table(spark, sf_dir, "ocr_blocks"), ["block_uid"], ["document_id", "page", "raw_text", "bbox", "is_code", "language", "confidence"])
    body = F.when(F.col("is_code"), F.concat(F.lit("[CODE:"), F.coalesce("language", F.lit("unknown")), F.lit("]\n"), F.col("raw_text"), F.lit("\n[/CODE]"))).otherwise(F.col("raw_text"))
    rows = b.where("raw_text is not null and trim(raw_text) <> ''").withColumn("x", F.struct(F.col("bbox.y").alias("y"), F.col("bbox.x").alias("x"), F.col("block_uid").alias("u"), body.alias("t")))
    by = rows.groupBy("document_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda r: r["t"]), "\n\n").alias("t"), F.count("*").alias("blocks"), F.avg("confidence").alias("c"))
    return by.select("document_id", "page", "blocks", F.sha2("t", 256).alias("text_hash"), F.round("c", 6).alias("confidence"), F.coalesce(F.col("c") < 60, F.lit(False)).alias("low_confidence"))


PAGE_SQL = """
WITH b AS (SELECT * FROM ocr_blocks QUALIFY row_number() OVER (PARTITION BY block_uid ORDER BY ingested_at DESC NULLS LAST) = 1),
r AS (SELECT *, CASE WHEN is_code THEN '[CODE:' || coalesce(language, 'unknown') || ']' || chr(10) || raw_text || chr(10) || '[/CODE]' ELSE raw_text END AS t FROM b WHERE raw_text IS NOT NULL AND trim(raw_text, ' ') <> '')
SELECT document_id, page, count(*) AS blocks, sha256(string_agg(t, chr(10) || chr(10) ORDER BY bbox.y, bbox.x, block_uid)) AS text_hash, round(sum(round(confidence * 1000000)::BIGINT) / count(confidence) / 1000000, 6) AS confidence, coalesce(avg(confidence) < 60, false) AS low_confidence
FROM r GROUP BY document_id, page"""

def video_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of about 300 words of each video, chapter by chapter, with their times."""
    from lectern.operators.video import pack_snippets

    c = _chunks(spark, sf_dir, "video_id", "start_sec", "end_sec", "raw_text").select("video_id", F.col("start_sec").alias("start"), F.col("end_sec").alias("end"), F.col("raw_text").alias("text"), F.col("chunk_id").alias("tie"))
    return pack_snippets(c, table(spark, sf_dir, "video_meta").select("video_id", "chapters")).select("video_id", "chunk_no", "chapter_index", "chapter_title", "start_sec", "end_sec", "words", F.sha2("text", 256).alias("text_hash"))


# parts over 2,500 characters are cut by sentences in the query; here such pages are left to it by a cut that never comes on pages of this size
SEGMENT_SQL = r"""
WITH p AS (SELECT page_id, list_filter(list_transform(string_split_regex(regexp_replace(coalesce(structured_markdown, ''), '\n(#{1,6}\s)', chr(1) || '\1', 'g'), '\n\s*\n|\x01'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS p
 FROM (SELECT * FROM handwritten_pages QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY ingested_at DESC NULLS LAST) = 1)),
m AS (SELECT page_id, list_reduce(list_transform(p, lambda q: [q]), lambda k, x: CASE WHEN len(k) > 0 AND length(x[1]) < 80 THEN list_append(k[:len(k) - 1], k[len(k)] || chr(10) || chr(10) || x[1]) ELSE list_append(k, x[1]) END, []::VARCHAR[]) AS m FROM p WHERE len(p) > 0),
c AS (SELECT page_id, unnest(range(len(m))) AS i, unnest(m) AS t FROM m)
SELECT page_id AS id, i::INT AS chunk_index, t AS chunk_text, len(regexp_extract_all(t, '[^ \t\n\r\f\x0B]+'))::INT AS words FROM c"""

QUERIES = {
    "video_chunks": video_chunks,
    "sliding_window_chunks": sliding_window_chunks, "lecture_summary_chunk": lecture_summaries, "concept_boundaries": concept_runs, "asof_chapter": asof_chapter, "pseudo_pages": document_pages, "word_windows": document_windows,
    "keyword_tf_top12": keyword_top12, "exact_text_dedup": exact_text_dedup, "prev_next_links": prev_next_links, "youtube_vector_records": youtube_records, "qna_parse_block": exam_blocks, "ocr_normalise": ocr_normalised, "ocr_page_text": page_texts,
    "handwritten_segments": _fold("pages", C.heading_segments), "image_pack": _fold("documents", C.token_chunks), "youtube_pack": _fold("documents", C.timed_chunks), "title_chunks": _fold("documents", C.title_chunks),
}
SQL = {
    "sliding_window_chunks": WINDOW_SQL, "lecture_summary_chunk": SUMMARY_SQL, "concept_boundaries": CONCEPT_SQL, "handwritten_segments": SEGMENT_SQL, "asof_chapter": CHAPTER_SQL, "pseudo_pages": PAGES_SQL, "word_windows": DOC_WINDOW_SQL, "keyword_tf_top12": KEYWORD_SQL, "exact_text_dedup": DEDUP_SQL,
    "prev_next_links": LINK_SQL, "youtube_vector_records": RECORD_SQL, "qna_parse_block": EXAM_SQL, "ocr_normalise": OCR_SQL, "ocr_page_text": PAGE_SQL,
}
