"""Page and word assembly, windows and halves, judging texts, prompts and job lists over the test tables, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import token_estimate
from lectern.operators.sequence import ordinals
from lectern.operators.stages import NOTHING_FOUND, PROMPTS, answer_prompt, judged, paragraphs, planner_share
from lectern.plans.evaluation_queries import LATEST_CHAT
from lectern.plans.judging_queries import BLOCKS_CTE, _blocks
from lectern.session import latest, table

LATEST_BLOCKS = "(SELECT * FROM ocr_blocks QUALIFY row_number() OVER (PARTITION BY block_uid ORDER BY ingested_at DESC NULLS LAST) = 1)"


def page_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a page as one: the box around them, texts in reading order, mean confidence; blocks of negative or no confidence are left out, and pages under 45 or of less than 3 characters."""
    b = latest(table(spark, sf_dir, "ocr_blocks"), ["block_uid"], ["document_id", "page", "raw_text", "bbox", "confidence"]).where("confidence >= 0 and bbox is not null")
    g = b.groupBy("document_id", "page").agg(
        F.min("bbox.x").alias("x"), F.min("bbox.y").alias("y"), (F.max(F.col("bbox.x") + F.col("bbox.w")) - F.min("bbox.x")).alias("w"), (F.max(F.col("bbox.y") + F.col("bbox.h")) - F.min("bbox.y")).alias("h"), F.round(F.avg("confidence"), 4).alias("confidence"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("bbox.y").alias("y"), F.col("bbox.x").alias("x"), "block_uid", F.coalesce("raw_text", F.lit("")).alias("t")))), lambda s: s["t"]), " ").alias("text"))
    return g.where((F.col("confidence") >= 45) & (F.length(F.trim("text")) >= 3)).select("document_id", "page", "x", "y", "w", "h", "confidence", F.sha2("text", 256).alias("text_hash"))


BOX_SQL = f"""WITH g AS (SELECT document_id, page, min(bbox.x) AS x, min(bbox.y) AS y, max(bbox.x + bbox.w) - min(bbox.x) AS w, max(bbox.y + bbox.h) - min(bbox.y) AS h, round(avg(confidence), 4) AS confidence, string_agg(coalesce(raw_text, ''), ' ' ORDER BY bbox.y, bbox.x, block_uid) AS text
 FROM {LATEST_BLOCKS} WHERE confidence >= 0 AND bbox IS NOT NULL GROUP BY ALL) SELECT document_id, page, x, y, w, h, confidence, sha256(text) AS text_hash FROM g WHERE confidence >= 45 AND length(trim(text, ' ')) >= 3"""


def page_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages read a second time where the first reading is unsure (mean confidence below 60): the second text (left join on the page) as one block, its stage appended."""
    b = latest(table(spark, sf_dir, "ocr_blocks"), ["block_uid"], ["document_id", "page", "block_id", "raw_text", "text", "confidence"])
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_id", "block_uid", F.coalesce(c, F.lit("")).alias("t")))), lambda s: s["t"]), "\n")
    first = b.groupBy("document_id", "page").agg(joined("raw_text").alias("one"), F.round(F.avg("confidence"), 2).alias("confidence"), F.count("*").alias("blocks"))
    second = b.where("text is not null and trim(text) <> ''").groupBy(F.col("document_id").alias("d"), F.col("page").alias("p")).agg(joined("text").alias("two"))
    x = first.join(second, F.col("document_id").eqNullSafe(F.col("d")) & F.col("page").eqNullSafe(F.col("p")), "left")
    new = F.coalesce(F.col("confidence") < 60, F.lit(False)) & F.col("two").isNotNull()
    return x.select("document_id", "page", F.sha2(F.when(new, F.col("two")).otherwise(F.col("one")), 256).alias("text_hash"), F.when(new, 1).otherwise(F.col("blocks")).alias("blocks"), F.array_join(F.when(new, F.array(F.lit("ocr"), F.lit("second"))).otherwise(F.array(F.lit("ocr"))), "+").alias("stages"))


REPLACE_SQL = f"""WITH b AS {LATEST_BLOCKS}, f AS (SELECT document_id, page, string_agg(coalesce(raw_text, ''), chr(10) ORDER BY block_id NULLS FIRST, block_uid) AS one, round(avg(confidence), 2) AS confidence, count(*) AS blocks FROM b GROUP BY ALL),
s AS (SELECT document_id AS d, page AS p, string_agg(text, chr(10) ORDER BY block_id NULLS FIRST, block_uid) AS two FROM b WHERE text IS NOT NULL AND trim(text, ' ') <> '' GROUP BY ALL),
x AS (SELECT *, coalesce(confidence < 60, false) AND two IS NOT NULL AS fresh FROM f LEFT JOIN s ON document_id IS NOT DISTINCT FROM d AND page IS NOT DISTINCT FROM p)
SELECT document_id, page, sha256(CASE WHEN fresh THEN two ELSE one END) AS text_hash, CASE WHEN fresh THEN 1 ELSE blocks END AS blocks, CASE WHEN fresh THEN 'ocr+second' ELSE 'ocr' END AS stages FROM x"""


def preview_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of all pages of a document in one running count, with a preview."""
    b = latest(table(spark, sf_dir, "ocr_blocks"), ["block_uid"], ["document_id", "page", "block_id", "raw_text"]).where("document_id is not null")
    return ordinals(b, "document_id", ["page", "block_id", "block_uid"], 50).select("document_id", "block_uid", F.col("ordinal").alias("chunk_index"), "page", F.substring(F.coalesce("raw_text", F.lit("")), 1, 120).alias("preview"))


def vector_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and vectors matched by id, never by position: how many of each have no partner, and whether the numbers agree."""
    d, v = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("d")), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("v"))
    return d.join(v, "doc_id", "full").agg(F.count_if(F.col("d").isNotNull() & F.col("v").isNotNull()).alias("matched"), F.count_if(F.col("v").isNull()).alias("without_vector"), F.count_if(F.col("d").isNull()).alias("without_document"), (F.count("d") == F.count("v")).alias("even"))


def lasting_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that are kept: with an id, and of 25 estimated tokens or more."""
    c = latest(table(spark, sf_dir, "youtube_chunks"), ["chunk_id"], ["raw_text"])
    return c.where((F.coalesce("chunk_id", F.lit("")) != "") & (token_estimate(F.col("raw_text")) >= 25)).select("chunk_id", token_estimate(F.col("raw_text")).alias("tokens"))


def window_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many segments each window of six shares with the one before and the one after it."""
    from lectern.plans.chunk_queries import sliding_window_chunks

    w = sliding_window_chunks(spark, sf_dir).select("lecture_id", "window_index", "segments")
    last = w.groupBy("lecture_id").agg(F.max("window_index").alias("last"))
    return w.join(last, "lecture_id").select("lecture_id", "window_index", "segments", F.when(F.col("window_index") == 0, 0).otherwise(2).alias("with_previous"), F.when(F.col("window_index") == F.col("last"), 0).otherwise(2).alias("with_next"))


def half_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question blocks of a sheet in one chunk, or in two halves where their estimated tokens pass 800 and there is more than one block."""
    b = _blocks(spark, sf_dir).select("doc_id", "position", "chars")
    n = b.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("chars") / 4)).alias("tokens"))
    second = (F.col("tokens") > 800) & (F.col("n") > 1) & (F.col("position") >= F.floor(F.col("n") / 2))
    return b.join(n, "doc_id").groupBy("doc_id", second.cast("int").alias("half")).agg(F.count("*").alias("blocks"), F.sum(F.floor(F.col("chars") / 4)).alias("tokens"))


HALF_SQL = f"""WITH {BLOCKS_CTE}, n AS (SELECT doc_id, count(*) AS n, sum(chars // 4) AS tokens FROM blocks GROUP BY doc_id)
SELECT doc_id, (tokens > 800 AND n > 1 AND position >= n // 2)::INT AS half, count(*) AS blocks, sum(chars // 4)::BIGINT AS tokens FROM blocks JOIN n USING (doc_id) GROUP BY doc_id, half"""


def judge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores read from a judge's text (a stand-in that marks an answer by its length, now and then without JSON)."""
    h = latest(table(spark, sf_dir, "chat_history"), ["id"], ["message", "response"], at="created_at")
    n, m = F.length(F.coalesce("response", F.lit(""))), F.length(F.coalesce("message", F.lit("")))
    said = F.concat(F.lit('Here it is:\n```json\n{"faithfulness": '), (n % 12).cast("string"), F.lit(', "relevance": '), (m % 11).cast("string"), F.lit(', "completeness": '), ((n + m) % 11).cast("string"), F.when(n % 2 == 0, F.concat(F.lit(', "overall": '), (n % 10).cast("string"))).otherwise(""), F.lit("}\n```"))
    j = judged(F.when(n % 7 == 0, F.lit("no judgement")).otherwise(said))
    return h.select("id", j["faithfulness"].alias("faithfulness"), j["relevance"].alias("relevance"), j["completeness"].alias("completeness"), j["overall"].alias("overall"))


JUDGE_SQL = f"""WITH h AS (SELECT id, length(coalesce(response, '')) AS n, length(coalesce(message, '')) AS m FROM {LATEST_CHAT}), p AS (SELECT id, n, CASE WHEN n % 7 <> 0 THEN least(n % 12 / 10, 1.0) END AS f, CASE WHEN n % 7 <> 0 THEN m % 11 / 10 END AS r, CASE WHEN n % 7 <> 0 THEN (n + m) % 11 / 10 END AS c FROM h)
SELECT id, round(f, 4)::DOUBLE AS faithfulness, round(r, 4)::DOUBLE AS relevance, round(c, 4)::DOUBLE AS completeness, round(CASE WHEN n % 7 = 0 THEN NULL WHEN n % 2 = 0 THEN n % 10 / 10 ELSE (f + r + c) / 3 END, 4)::DOUBLE AS overall FROM p"""


def answer_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model would be asked for each question, from the previews of its sources; the fixed answer where there are none."""
    from lectern.plans.evaluation_queries import _answers

    a = _answers(spark, sf_dir)
    mode = F.when(F.col("message").startswith("Summary"), "summarize").when(F.col("message").startswith("Flashcards"), "quiz").otherwise("ask")
    context = F.array_join(F.transform("items", lambda i: F.concat(F.lit("["), F.coalesce(i["citation"].cast("string"), F.lit("?")), F.lit("] "), F.coalesce(i["preview"], F.lit("")))), "\n")
    prompt = answer_prompt(mode, F.coalesce("message", F.lit("")), context, F.lit(None).cast("string"))
    return a.select("id", (F.size("items") == 0).alias("canned"), F.sha2(prompt, 256).alias("prompt_hash"))


PROMPT_SQL = f"""WITH a AS (SELECT id, coalesce(message, '') AS m, coalesce(try_cast(CASE WHEN json_valid(sources) THEN json_extract(sources, '$.items[*]') END AS JSON[]), []) AS items FROM {LATEST_CHAT}),
c AS (SELECT *, array_to_string(list_transform(items, lambda i: '[' || coalesce(i ->> 'citation', '?') || '] ' || coalesce(i ->> 'preview', '')), chr(10)) AS context FROM a)
SELECT id, len(items) = 0 AS canned, sha256(CASE WHEN context = '' THEN '{NOTHING_FOUND}' ELSE CASE WHEN m LIKE 'Summary%' THEN '{PROMPTS['summarize']}' WHEN m LIKE 'Flashcards%' THEN '{PROMPTS['quiz']}' ELSE '{PROMPTS['ask']}' END
 || chr(10) || chr(10) || 'Sources:' || chr(10) || context || chr(10) || chr(10) || 'Question: ' || m END) AS prompt_hash FROM c"""


def job_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs as the last of the events of each user, newest first, at most 20 (the list's page): state, whether it may still be cancelled, when it was created and changed."""
    e = table(spark, sf_dir, "events").where("ts is not null and user_id is not null")
    j = e.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("l"), F.min("ts").alias("created"), F.count("*").alias("changes"))
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return j.orderBy(F.col("l.ts").desc(), "user_id").limit(20).select(F.col("user_id").alias("job_id"), F.col("l.event_type").alias("state"), (F.col("l.event_type") == "click").alias("may_cancel"), iso("created").alias("created"), iso("l.ts").alias("changed"), "changes")


JOB_SQL = """SELECT user_id AS job_id, arg_max(event_type, (ts, event_id)) AS state, arg_max(event_type, (ts, event_id)) = 'click' AS may_cancel, strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS created, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS changed, count(*) AS changes
FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL GROUP BY user_id ORDER BY max(ts) DESC, user_id LIMIT 20"""


def paragraph_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of paragraphs of each text and a hash of them."""
    p = paragraphs(F.col("transcript"))
    return latest(table(spark, sf_dir, "handwritten_pages"), ["page_id"], ["transcript"]).select("page_id", F.size(p).alias("paragraphs"), F.sha2(F.array_join(p, "\n\n"), 256).alias("text_hash"))


def planner_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the time of each kind of event that its clicks take, by hour (a stand-in for a planner's share), at most 1."""
    e = table(spark, sf_dir, "events").where("ts is not null")
    g = e.groupBy(F.date_format("ts", "yyyy-MM-dd HH").alias("hour")).agg(F.sum(F.when(F.col("event_type") == "click", F.round(F.col("value") * 100).cast("long"))).alias("own"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("whole"))
    return g.select("hour", F.round(planner_share(F.coalesce("own", F.lit(0)), F.coalesce("whole", F.lit(0))), 6).alias("share"))


QUERIES = {
    "page_boxes": page_boxes, "page_replaced": page_replaced, "preview_flatten": preview_flatten, "vector_zip": vector_zip, "lasting_chunks": lasting_chunks, "window_overlaps": window_overlaps, "half_split": half_split, "judge_scores": judge_scores,
    "answer_prompts": answer_prompts, "job_list": job_list, "paragraph_split": paragraph_split, "planner_ratio": planner_ratio,
}


def _sql() -> dict[str, str]:
    from lectern.plans.chunk_queries import WINDOW_SQL
    from lectern.plans.retrieval_queries import LATEST_CHUNKS

    tokens = r"greatest(1, floor(len(regexp_extract_all(coalesce(raw_text, ''), '[^ \t\n\r\f\x0B]+')) * 1.3))::INT"
    return {
        "page_boxes": BOX_SQL, "page_replaced": REPLACE_SQL, "half_split": HALF_SQL, "judge_scores": JUDGE_SQL, "answer_prompts": PROMPT_SQL, "job_list": JOB_SQL,
        "preview_flatten": f"SELECT document_id, block_uid, row_number() OVER (PARTITION BY document_id ORDER BY page NULLS FIRST, block_id NULLS FIRST, block_uid) - 1 AS chunk_index, page, substring(coalesce(raw_text, ''), 1, 120) AS preview FROM {LATEST_BLOCKS} WHERE document_id IS NOT NULL",
        "vector_zip": "SELECT count(*) FILTER (doc_id IS NOT NULL AND vec_id IS NOT NULL) AS matched, count(*) FILTER (vec_id IS NULL) AS without_vector, count(*) FILTER (doc_id IS NULL) AS without_document, count(doc_id) = count(vec_id) AS even FROM documents FULL JOIN embeddings ON doc_id = vec_id",
        "lasting_chunks": f"SELECT chunk_id, {tokens} AS tokens FROM {LATEST_CHUNKS} WHERE coalesce(chunk_id, '') <> '' AND {tokens} >= 25",
        "window_overlaps": f"SELECT lecture_id, window_index, segments, CASE WHEN window_index = 0 THEN 0 ELSE 2 END AS with_previous, coalesce(lead(2) OVER (PARTITION BY lecture_id ORDER BY window_index), 0) AS with_next FROM ({WINDOW_SQL})",
        "planner_ratio": "WITH g AS (SELECT strftime(ts, '%Y-%m-%d %H') AS hour, sum(round(value * 100)::BIGINT) FILTER (event_type = 'click') AS own, sum(round(value * 100)::BIGINT) AS whole FROM events WHERE ts IS NOT NULL GROUP BY ALL) SELECT hour, round(CASE WHEN whole > 0 THEN least(coalesce(own, 0) / whole, 1.0) ELSE 0 END, 6)::DOUBLE AS share FROM g",
    }


SQL = _sql()
