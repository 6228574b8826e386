"""Product lists, chunk builders and ingestion audits over the test tables, with SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.text import clean, word_count, word_list
from lectern.operators.sequence import carry_forward, ordinals, running_sum
from lectern.plans.evaluation_queries import LATEST_CHAT
from lectern.plans.retrieval_queries import LATEST_CHUNKS
from lectern.session import latest, table

LATEST_PAGES = "(SELECT * FROM handwritten_pages QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY ingested_at DESC NULLS LAST) = 1)"
LATEST_SEGMENTS = "(SELECT * FROM segments QUALIFY row_number() OVER (PARTITION BY lecture_id, segment_index ORDER BY ingested_at DESC NULLS LAST) = 1)"
LATEST_BLOCKS = "(SELECT * FROM ocr_blocks QUALIFY row_number() OVER (PARTITION BY block_uid ORDER BY ingested_at DESC NULLS LAST) = 1)"


def student_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Courses of each user (those they asked in), newest course first."""
    joined = table(spark, sf_dir, "chat_history").select("user_id", "course_id").distinct().join(table(spark, sf_dir, "courses").select("course_id", "course_name", "created_at"), "course_id")
    place = Window.partitionBy("user_id").orderBy(F.col("created_at").desc(), "course_id")  # at most one row a course
    return joined.select("user_id", "course_id", "course_name", F.row_number().over(place).alias("place"))


STUDENT_SQL = "SELECT user_id, c.course_id, course_name, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, c.course_id) AS place FROM (SELECT DISTINCT user_id, course_id FROM chat_history) h JOIN courses c ON c.course_id = h.course_id"


def subject_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in courses of physics (semi join)."""
    own = table(spark, sf_dir, "courses").where("lower(subject) = 'physics'").select("course_id")
    return latest(table(spark, sf_dir, "chat_history"), ["id"], ["course_id", "user_id"], at="created_at").join(own, "course_id", "left_semi").select("id", "user_id", "course_id")


def unclear_lectures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lectures with at least one unclear segment (exists), and whether their course is known (mark)."""
    unclear = latest(table(spark, sf_dir, "segments"), ["lecture_id", "segment_index"], ["is_unclear"]).where("is_unclear").select("lecture_id").distinct()
    known = table(spark, sf_dir, "courses").select("course_id", F.lit(True).alias("known"))
    return table(spark, sf_dir, "lectures").join(unclear, "lecture_id", "left_semi").join(known, "course_id", "left").select("lecture_id", "course_id", F.coalesce("known", F.lit(False)).alias("known"))


def quiet_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Courses in which no defective answer was given: none is empty or without citation numbers (anti join)."""
    bad = latest(table(spark, sf_dir, "chat_history"), ["id"], ["course_id", "response"], at="created_at").where("response is null or trim(response) = ''").select("course_id").distinct()
    return table(spark, sf_dir, "courses").join(bad, "course_id", "left_anti").select("course_id", "course_name")


def tags_sanitised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags without blanks and the placeholder 'string'; languages of the same kind, ['en'] where none is left."""
    c = latest(table(spark, sf_dir, "youtube_chunks"), ["chunk_id"], ["tags", "transcript_language"])
    sound = lambda a: F.filter(a, lambda x: x.isNotNull() & (x != "") & (x != "string"))
    languages = sound(F.array("transcript_language"))
    return c.select("chunk_id", F.array_join(F.coalesce(sound(F.col("tags")), F.array().cast("array<string>")), "|").alias("tags"), F.array_join(F.when(F.size(languages) > 0, languages).otherwise(F.array(F.lit("en"))), "|").alias("languages"))


TAGS_SQL = f"SELECT chunk_id, coalesce(array_to_string(list_filter(tags, lambda x: x IS NOT NULL AND x <> '' AND x <> 'string'), '|'), '') AS tags, CASE WHEN transcript_language IS NULL OR transcript_language IN ('', 'string') THEN 'en' ELSE transcript_language END AS languages FROM {LATEST_CHUNKS}"


def materials_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Materials of each course that are recordings (by their source) and those that are not; a null source is not."""
    video = F.coalesce(F.lower("source").rlike("video|audio|youtube"), F.lit(False))
    return table(spark, sf_dir, "documents").groupBy("course_id").agg(F.count_if(video).alias("recordings"), F.count_if(~video).alias("documents"))


def page_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page on which every thousandth character of a file stands: pages are joined in order with one line end between them."""
    p = latest(table(spark, sf_dir, "handwritten_pages"), ["page_id"], ["source_file", "page_number", "transcript"]).where("source_file is not null")
    p = p.select("page_id", "source_file", "page_number", (F.length(F.coalesce("transcript", F.lit(""))) + 1).cast("long").alias("chars"))
    x = running_sum(p, "source_file", ["page_number", "page_id"], 200, F.col("chars"), "start")
    first = F.ceil(F.col("start") / 1000).cast("long")
    last = F.floor((F.col("start") + F.col("chars") - 1) / 1000).cast("long")
    return x.where(first <= last).select("source_file", F.explode(F.sequence(first, last)).alias("k"), "page_number", "page_id").select("source_file", (F.col("k") * 1000).alias("char_offset"), "page_number", "page_id")


OFFSET_SQL = f"""WITH p AS (SELECT *, coalesce(sum(chars) OVER (PARTITION BY source_file ORDER BY page_number NULLS FIRST, page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
 FROM (SELECT page_id, source_file, page_number, length(coalesce(transcript, '')) + 1 AS chars FROM {LATEST_PAGES} WHERE source_file IS NOT NULL)),
o AS (SELECT source_file, unnest(range(0, (max(start + chars))::BIGINT, 1000)) AS char_offset FROM p GROUP BY source_file)
SELECT o.source_file, char_offset, page_number, page_id FROM o ASOF JOIN p ON o.source_file = p.source_file AND o.char_offset >= p.start"""


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = latest(table(spark, sf_dir, "ocr_blocks"), ["block_uid"], ["document_id", "page", "block_id", "block_type", "raw_text", "confidence", "is_code", "warnings"]).where("document_id is not null")
    title = F.when(F.col("block_type") == "heading", F.substring(F.trim(F.substring_index(F.coalesce("raw_text", F.lit("")), "\n", 1)), 1, 160))
    order = ["page", "block_id", "block_uid"]
    return ordinals(carry_forward(b, "document_id", order, 50, title, "section"), "document_id", order, 50)


def section_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each scanned block with its place in the document and the section it is in: the first line of the last heading up to it."""
    return _placed(spark, sf_dir).select("block_uid", "ordinal", "section")


PLACED = rf"""p AS (SELECT *, row_number() OVER w - 1 AS ordinal, last_value(CASE WHEN block_type = 'heading' THEN substring(trim(split_part(coalesce(raw_text, ''), chr(10), 1), ' '), 1, 160) END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section
 FROM {LATEST_BLOCKS} WHERE document_id IS NOT NULL WINDOW w AS (PARTITION BY document_id ORDER BY page NULLS FIRST, block_id NULLS FIRST, block_uid))"""


def window_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of five blocks: their pages, mean of positive confidences, first section, code, warnings (at most 20), blocks that do not repeat the one before, share of distinct words."""
    x = _placed(spark, sf_dir).withColumn("window", F.floor(F.col("ordinal") / 5))
    g = x.groupBy("document_id", "window").agg(
        F.array_join(F.transform(F.array_sort(F.collect_set("page")), lambda p: p.cast("string")), ",").alias("pages"), F.round(F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))), 4).alias("confidence"),
        F.min_by("section", F.when(F.col("section").isNotNull() & (F.col("section") != ""), F.col("ordinal"))).alias("section"), F.max(F.coalesce("is_code", F.lit(False))).alias("has_code"),
        F.size(F.slice(F.array_distinct(F.flatten(F.collect_list(F.coalesce("warnings", F.array().cast("array<string>"))))), 1, 20)).alias("warnings"),
        F.array_sort(F.collect_list(F.struct("ordinal", F.trim(F.coalesce("raw_text", F.lit(""))).alias("t")))).alias("b"))
    texts = F.transform("b", lambda s: s["t"])
    kept = F.filter(F.transform(texts, lambda t, i: F.when((i == 0) | (t != F.get(texts, i - 1)), t)), lambda t: t.isNotNull())
    words = word_list(F.lower(F.array_join(kept, "\n")))
    return g.select("document_id", "window", "pages", "confidence", "section", "has_code", "warnings", F.size(kept).alias("blocks"), F.when(F.size(words) > 0, F.round(F.size(F.array_distinct(words)) / F.size(words), 4)).otherwise(0.0).alias("lexical_density"), F.sha2(F.array_join(kept, "\n"), 256).alias("text_hash"))


WINDOW_SQL = "WITH " + PLACED + r""", g AS (SELECT document_id, (ordinal // 5)::BIGINT AS "window", list_sort(list_distinct(list(page))) AS pages, round(avg(confidence) FILTER (confidence > 0), 4) AS confidence, arg_min(section, ordinal) FILTER (section <> '') AS section, bool_or(coalesce(is_code, false)) AS has_code,
 len(list_distinct(flatten(list(coalesce(warnings, []))))[:20])::INT AS warnings, list(trim(coalesce(raw_text, ''), ' ') ORDER BY ordinal) AS b FROM p GROUP BY ALL),
k AS (SELECT *, list_transform(list_filter(range(1, len(b) + 1), lambda i: i = 1 OR b[i] <> b[i - 1]), lambda i: b[i]) AS kept FROM g), w AS (SELECT *, regexp_extract_all(lower(array_to_string(kept, chr(10))), '[^ \t\n\r\f\x0B]+') AS words FROM k)
SELECT document_id, "window", array_to_string(pages, ',') AS pages, confidence, section, has_code, warnings, len(kept)::INT AS blocks, CASE WHEN len(words) > 0 THEN round(len(list_distinct(words)) / len(words), 4) ELSE 0 END::DOUBLE AS lexical_density, sha256(array_to_string(kept, chr(10))) AS text_hash FROM w"""


def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of video chunks in the five forms records are stored under."""
    c = latest(table(spark, sf_dir, "youtube_chunks"), ["chunk_id"], ["video_id", "chunk_index", "raw_text", "chapter_index"])
    s = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(""))
    return c.select(
        "chunk_id", F.substring(F.md5(F.concat(s("video_id"), F.lit(":"), s("chapter_index"), F.lit(":"), F.substring(s("raw_text"), 1, 100))), 1, 12).alias("by_cluster"), F.substring(F.sha2(F.concat(s("video_id"), F.lit("|sliding_window|"), s("chunk_index")), 256), 1, 24).alias("by_strategy"),
        F.substring(F.sha2(F.concat(F.lit("/"), s("video_id"), F.lit("::"), s("chunk_index")), 256), 1, 32).alias("by_path"), F.substring(F.sha2(F.concat(s("chunk_index"), F.lit(":"), F.substring(s("raw_text"), 1, 200)), 256), 1, 16).alias("by_text"),
        F.concat(s("video_id"), F.lit("::p"), s("chapter_index"), F.lit("::c"), s("chunk_index")).alias("by_page"))


def _s(c: str) -> str:
    return f"coalesce({c}::VARCHAR, '')"


IDS_SQL = f"""SELECT chunk_id, substring(md5({_s('video_id')} || ':' || {_s('chapter_index')} || ':' || substring({_s('raw_text')}, 1, 100)), 1, 12) AS by_cluster, substring(sha256({_s('video_id')} || '|sliding_window|' || {_s('chunk_index')}), 1, 24) AS by_strategy,
 substring(sha256('/' || {_s('video_id')} || '::' || {_s('chunk_index')}), 1, 32) AS by_path, substring(sha256({_s('chunk_index')} || ':' || substring({_s('raw_text')}, 1, 200)), 1, 16) AS by_text, {_s('video_id')} || '::p' || {_s('chapter_index')} || '::c' || {_s('chunk_index')} AS by_page FROM {LATEST_CHUNKS}"""


def clean_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.length(clean(F.col("text"))).alias("chars"), F.sha2(clean(F.col("text")), 256).alias("text_hash"))


CLEAN_SQL = r"WITH c AS (SELECT doc_id, trim(regexp_replace(replace(coalesce(text, ''), chr(0), ''), '\n{3,}', chr(10) || chr(10), 'g'), ' ') AS t FROM documents) SELECT doc_id, length(t) AS chars, sha256(t) AS text_hash FROM c"


def active_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of the lecture that a segment names, all of them where it names none."""
    s = latest(table(spark, sf_dir, "segments"), ["lecture_id", "segment_index"], ["text"])
    l = table(spark, sf_dir, "lectures").groupBy("lecture_id").agg(F.max("topics").alias("topics"))
    x = s.join(l, "lecture_id").withColumn("low", F.lower(F.coalesce("text", F.lit(""))))
    named = F.filter("topics", lambda t: F.contains(F.col("low"), F.lower(t)))
    return x.select("lecture_id", "segment_index", F.array_join(F.when(F.size(named) > 0, named).otherwise(F.col("topics")), "|").alias("concepts"), (F.size(named) > 0).alias("named"))


CONCEPT_SQL = f"""WITH x AS (SELECT s.lecture_id, segment_index, topics, list_filter(topics, lambda t: contains(lower(coalesce(text, '')), lower(t))) AS n FROM {LATEST_SEGMENTS} s JOIN lectures l ON l.lecture_id = s.lecture_id)
SELECT lecture_id, segment_index, array_to_string(CASE WHEN len(n) > 0 THEN n ELSE topics END, '|') AS concepts, coalesce(len(n) > 0, false) AS named FROM x"""


def _elements(text: Column) -> Column:
    """Typed elements of a text, by blank lines: ListItem, Table, Title (at most 110 characters and 12 words, one line, no sentence mark at the end), NarrativeText."""

    def kind(p: Column) -> Column:
        return (
            F.when(p.rlike(r"^(?:[-*•]|\d{1,3}[.)])\s+\S"), "ListItem").when(p.rlike(r"^\|.*\|"), "Table")
            .when((F.length(p) <= 110) & ~F.contains(p, F.lit("\n")) & (F.size(F.split(p, r"\s+")) <= 12) & ~p.rlike(r"[.,;:!?]$"), "Title").otherwise("NarrativeText")
        )

    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(kind(p).alias("kind"), p.alias("text")))


def document_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of each document from its elements: first title (else the stored one), kinds in order of appearance, their numbers, a preview, and the text that is embedded."""
    e = F.col("e")
    of = lambda k: F.size(F.filter("e", lambda x: x["kind"] == k))
    first = F.try_element_at(F.filter("e", lambda x: x["kind"] == "Title"), F.lit(1))["text"]
    x = table(spark, sf_dir, "documents").select("doc_id", "title", _elements(F.col("text")).alias("e")).withColumn("section", F.substring(F.coalesce(first, "title", F.lit("")), 1, 160))
    body = F.array_join(F.transform(e, lambda x: F.when(x["kind"] == "Table", F.concat(F.lit("[TABLE: "), x["text"], F.lit("]"))).otherwise(x["text"])), "\n\n")
    embedded = F.array_join(F.filter(F.array(F.when(F.col("section") != "", F.concat(F.lit("[SECTION: "), F.col("section"), F.lit("]"))), body), lambda p: p.isNotNull() & (p != "")), "\n\n")
    return x.select("doc_id", "section", F.array_join(F.array_distinct(F.transform(e, lambda x: x["kind"])), ",").alias("element_types"), F.size("e").alias("elements"), of("Title").alias("titles"), of("ListItem").alias("list_items"), (of("Table") > 0).alias("has_table"), F.substring(body, 1, 300).alias("preview"), F.sha2(embedded, 256).alias("embedded_hash"))


ELEMENT_SQL = r"""WITH d AS (SELECT doc_id, title, list_filter(list_transform(string_split_regex(coalesce(text, ''), '\n\s*\n'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '') AS p FROM documents),
e AS (SELECT *, list_transform(p, lambda q: CASE WHEN regexp_matches(q, '^(?:[-*•]|\d{1,3}[.)])\s+\S') THEN 'ListItem' WHEN regexp_matches(q, '^\|.*\|') THEN 'Table'
 WHEN length(q) <= 110 AND NOT contains(q, chr(10)) AND len(string_split_regex(q, '\s+')) <= 12 AND NOT regexp_matches(q, '[.,;:!?]$') THEN 'Title' ELSE 'NarrativeText' END) AS k FROM d),
f AS (SELECT *, substring(coalesce(p[list_position(k, 'Title')], title, ''), 1, 160) AS section, array_to_string(list_transform(range(1, len(p) + 1), lambda i: CASE WHEN k[i] = 'Table' THEN '[TABLE: ' || p[i] || ']' ELSE p[i] END), chr(10) || chr(10)) AS body FROM e)
SELECT doc_id, section, array_to_string(list_transform(list_sort(list_transform(list_distinct(k), lambda x: list_position(k, x))), lambda i: k[i]), ',') AS element_types, len(k)::INT AS elements, len(list_filter(k, lambda x: x = 'Title'))::INT AS titles, len(list_filter(k, lambda x: x = 'ListItem'))::INT AS list_items,
 list_contains(k, 'Table') AS has_table, substring(body, 1, 300) AS preview, sha256(array_to_string(list_filter([CASE WHEN section <> '' THEN '[SECTION: ' || section || ']' END, body], lambda x: x IS NOT NULL AND x <> ''), chr(10) || chr(10))) AS embedded_hash FROM f"""


def handwritten_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the header that is put before their text ([course | topic | Page n], blanks passed over) and their flattened metadata."""
    p = latest(table(spark, sf_dir, "handwritten_pages"), ["page_id"], ["course_id", "topic", "page_number", "transcript", "confidence", "keywords", "model_used"])
    c = table(spark, sf_dir, "courses").select("course_id", "course_name")
    x = p.join(c, "course_id", "left")
    header = F.concat(F.lit("["), F.concat_ws(" | ", F.when(F.col("course_name") != "", F.col("course_name")), F.when(F.col("topic") != "", F.col("topic")), F.concat(F.lit("Page "), F.col("page_number").cast("string"))), F.lit("]"))
    text = F.concat(header, F.lit("\n"), F.coalesce("transcript", F.lit("")))
    return x.select("page_id", header.alias("header"), F.sha2(text, 256).alias("text_hash"), F.round(F.coalesce("confidence", F.lit(0.5)), 4).alias("confidence"), F.substring(F.coalesce("transcript", F.lit("")), 1, 300).alias("preview"), F.array_join(F.slice(F.coalesce("keywords", F.array().cast("array<string>")), 1, 10), ",").alias("keywords"),
                    F.coalesce(F.col("confidence") < 0.75, F.lit(True)).alias("escalate"))


HAND_SQL = f"""WITH x AS (SELECT p.*, course_name, '[' || concat_ws(' | ', nullif(course_name, ''), nullif(topic, ''), 'Page ' || page_number) || ']' AS header FROM {LATEST_PAGES} p LEFT JOIN courses c ON c.course_id = p.course_id)
SELECT page_id, header, sha256(header || chr(10) || coalesce(transcript, '')) AS text_hash, round(coalesce(confidence, 0.5), 4) AS confidence, substring(coalesce(transcript, ''), 1, 300) AS preview, coalesce(array_to_string(keywords[:10], ','), '') AS keywords, coalesce(confidence < 0.75, true) AS escalate FROM x"""


def video_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic (chapter, else title, 80 characters), summary (the first 70 words), label of the span, and link into the video of each chunk."""
    c = latest(table(spark, sf_dir, "youtube_chunks"), ["chunk_id"], ["chapter_title", "video_title", "raw_text"])
    topic = F.substring(F.coalesce(F.when(~F.col("chapter_title").isin("", "Unknown"), F.col("chapter_title")), F.when(F.col("video_title") != "", F.col("video_title")), F.lit("Lecture")), 1, 80)
    w = word_list(F.col("raw_text"))
    return c.select("chunk_id", topic.alias("topic"), F.concat(F.array_join(F.slice(w, 1, 70), " "), F.when(F.size(w) > 70, "...").otherwise("")).alias("summary"))


VIDEO_META_SQL = rf"""WITH c AS (SELECT *, regexp_extract_all(coalesce(raw_text, ''), '[^ \t\n\r\f\x0B]+') AS w FROM {LATEST_CHUNKS})
SELECT chunk_id, substring(coalesce(CASE WHEN chapter_title NOT IN ('', 'Unknown') THEN chapter_title END, nullif(video_title, ''), 'Lecture'), 1, 80) AS topic, array_to_string(w[:70], ' ') || CASE WHEN len(w) > 70 THEN '...' ELSE '' END AS summary FROM c"""


def ingest_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of each course by the model that read them, with those to be escalated, without text, and the words they hold."""
    p = latest(table(spark, sf_dir, "handwritten_pages"), ["page_id"], ["course_id", "model_used", "confidence", "transcript"])
    m = F.lower(F.coalesce("model_used", F.lit("")))
    return p.groupBy("course_id").agg(F.count("*").alias("pages"), F.count_if(F.contains(m, F.lit("flash"))).alias("flash"), F.count_if(F.contains(m, F.lit("pro"))).alias("pro"), F.count_if(F.coalesce(F.col("confidence") < 0.75, F.lit(True))).alias("escalated"), F.count_if(F.coalesce(F.trim("transcript"), F.lit("")) == "").alias("blank"), F.sum(word_count(F.col("transcript"))).cast("long").alias("words"))


AUDIT_SQL = rf"""SELECT course_id, count(*) AS pages, count(*) FILTER (contains(lower(coalesce(model_used, '')), 'flash')) AS flash, count(*) FILTER (contains(lower(coalesce(model_used, '')), 'pro')) AS pro, count(*) FILTER (coalesce(confidence < 0.75, true)) AS escalated,
 count(*) FILTER (coalesce(trim(transcript, ' '), '') = '') AS blank, sum(len(regexp_extract_all(coalesce(transcript, ''), '[^ \t\n\r\f\x0B]+')))::BIGINT AS words FROM {LATEST_PAGES} GROUP BY course_id"""


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of each scanned page: the texts of its blocks that are neither code nor table cells, else all raw texts; mean confidence and whether the page is to be read again (below 60, code below 50)."""
    b = latest(table(spark, sf_dir, "ocr_blocks"), ["block_uid"], ["document_id", "page", "block_id", "block_type", "raw_text", "text", "confidence", "is_code"])
    plain = ~F.coalesce(F.col("is_code"), F.lit(False)) & ~F.coalesce(F.col("block_type") == "table_cell", F.lit(False)) & (F.coalesce(F.trim("text"), F.lit("")) != "")
    g = b.groupBy("document_id", "page").agg(
        F.array_sort(F.collect_list(F.struct("block_id", "block_uid", F.when(plain, F.trim("text")).alias("t"), F.coalesce("raw_text", F.lit("")).alias("r")))).alias("b"), F.round(F.avg("confidence"), 4).alias("confidence"),
        F.count_if(F.coalesce(F.col("is_code") & (F.col("confidence") < 50), F.lit(False))).alias("weak_code"))
    some = F.array_join(F.filter(F.transform("b", lambda s: s["t"]), lambda t: t.isNotNull()), "\n\n")
    return g.select("document_id", "page", F.sha2(F.when(some != "", some).otherwise(F.array_join(F.transform("b", lambda s: s["r"]), "\n\n")), 256).alias("text_hash"), "confidence", (F.coalesce(F.col("confidence") < 60, F.lit(False)) | (F.col("weak_code") > 0)).alias("again"))


PAGE_SQL = f"""WITH g AS (SELECT document_id, page, array_to_string(list(CASE WHEN NOT coalesce(is_code, false) AND coalesce(block_type, '') <> 'table_cell' AND coalesce(trim(text, ' '), '') <> '' THEN trim(text, ' ') END ORDER BY block_id NULLS FIRST, block_uid) FILTER (NOT coalesce(is_code, false) AND coalesce(block_type, '') <> 'table_cell' AND coalesce(trim(text, ' '), '') <> ''), chr(10) || chr(10)) AS t,
 array_to_string(list(coalesce(raw_text, '') ORDER BY block_id NULLS FIRST, block_uid), chr(10) || chr(10)) AS r, round(avg(confidence), 4) AS confidence, count(*) FILTER (is_code AND confidence < 50) AS weak FROM {LATEST_BLOCKS} GROUP BY ALL)
SELECT document_id, page, sha256(CASE WHEN coalesce(t, '') <> '' THEN t ELSE r END) AS text_hash, confidence, coalesce(confidence < 60, false) OR weak > 0 AS again FROM g"""


def created_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of courses and questions as ISO texts."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    last = table(spark, sf_dir, "chat_history").groupBy("course_id").agg(F.max("created_at").alias("last"))
    return table(spark, sf_dir, "courses").join(last, "course_id", "left").select("course_id", iso("created_at").alias("created"), iso("last").alias("last_question"))


ISO_SQL = "SELECT c.course_id, strftime(c.created_at, '%Y-%m-%dT%H:%M:%S+00:00') AS created, strftime(l, '%Y-%m-%dT%H:%M:%S+00:00') AS last_question FROM courses c LEFT JOIN (SELECT course_id, max(created_at) AS l FROM chat_history GROUP BY 1) h ON h.course_id = c.course_id"

QUERIES = {
    "student_courses": student_courses, "subject_answers": subject_answers, "unclear_lectures": unclear_lectures, "quiet_courses": quiet_courses, "tags_sanitised": tags_sanitised, "materials_split": materials_split, "page_offsets": page_offsets,
    "section_carry": section_carry, "window_metadata": window_metadata, "chunk_ids": chunk_ids, "clean_texts": clean_texts, "active_concepts": active_concepts, "document_metadata": document_metadata, "handwritten_chunks": handwritten_chunks,
    "video_metadata": video_metadata, "ingest_audit": ingest_audit, "page_text": page_text, "iso_times": created_at,
}
SQL = {
    "student_courses": STUDENT_SQL, "subject_answers": f"SELECT id, user_id, course_id FROM {LATEST_CHAT} WHERE course_id IN (SELECT course_id FROM courses WHERE lower(subject) = 'physics')",
    "unclear_lectures": f"SELECT lecture_id, l.course_id, c.course_id IS NOT NULL AS known FROM lectures l LEFT JOIN courses c ON c.course_id = l.course_id WHERE lecture_id IN (SELECT lecture_id FROM {LATEST_SEGMENTS} WHERE is_unclear)",
    "quiet_courses": f"SELECT course_id, course_name FROM courses c WHERE NOT EXISTS (SELECT 1 FROM {LATEST_CHAT} h WHERE h.course_id = c.course_id AND (response IS NULL OR trim(response, ' ') = ''))",
    "tags_sanitised": TAGS_SQL, "materials_split": "SELECT course_id, count(*) FILTER (coalesce(regexp_matches(lower(source), 'video|audio|youtube'), false)) AS recordings, count(*) FILTER (NOT coalesce(regexp_matches(lower(source), 'video|audio|youtube'), false)) AS documents FROM documents GROUP BY course_id",
    "page_offsets": OFFSET_SQL, "section_carry": "WITH " + PLACED + " SELECT block_uid, ordinal, section FROM p", "window_metadata": WINDOW_SQL, "chunk_ids": IDS_SQL, "clean_texts": CLEAN_SQL, "active_concepts": CONCEPT_SQL,
    "document_metadata": ELEMENT_SQL, "handwritten_chunks": HAND_SQL, "video_metadata": VIDEO_META_SQL, "ingest_audit": AUDIT_SQL, "page_text": PAGE_SQL, "iso_times": ISO_SQL,
}
