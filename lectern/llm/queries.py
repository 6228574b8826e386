"""The queries of the training-data problems over the course-content tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import latest, materialize, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.turns import speaker_turns

    turns = speaker_turns(table(spark, sf_dir, "segments"), table(spark, sf_dir, "lectures"), texts=False)
    return turns.where(F.col("speaker").isNotNull()).select("lecture_id", "first_segment", "last_segment", "speaker").distinct()


def p1_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lecture_id, first_segment, last_segment, speaker, text, unclear_segments, segments``: each turn with its clean text."""
    from lectern.llm.turns import speaker_turns

    turns = speaker_turns(table(spark, sf_dir, "segments"), table(spark, sf_dir, "lectures"))
    return turns.select("lecture_id", "first_segment", "last_segment", "speaker", "text", "unclear_segments", "segments")


def _chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = latest(table(spark, sf_dir, "youtube_chunks"), ["chunk_id"], ["raw_text", "summary"])
    return chunks.where(F.col("chunk_id").isNotNull()).select(F.col("chunk_id").alias("id"), F.concat(F.coalesce("raw_text", F.lit("")), F.lit(" "), F.coalesce("summary", F.lit(""))).alias("text"))


#: As TESTDATA.md defines problem 3: three words, half of them shared.
P3 = {"k": 3, "threshold": 0.5, "bands": 80, "rows": 4}


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.neardup import expand_pairs, near_duplicates

    members, links = near_duplicates(_chunk_texts(spark, sf_dir), "id", **P3)
    return expand_pairs(members, links).select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b")).distinct()


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``chunk_id, group_id``: the groups of chunks that p3_found's pairs tie together."""
    from lectern.llm.neardup import groups, near_duplicates

    members, links = near_duplicates(_chunk_texts(spark, sf_dir), "id", **P3)
    return groups(members, links).select(F.col("id").alias("chunk_id"), F.col("group").alias("group_id"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.markup import markup_to_text

    pages = latest(table(spark, sf_dir, "handwritten_pages"), ["page_id"], ["structured_markdown", "transcript"])
    found = markup_to_text(pages, "page_id", ["structured_markdown", "transcript"]).select(F.col("id").alias("page_id"), "field", F.explode("elements").alias("e"))
    return found.select("page_id", "field", F.col("e.ordinal").alias("ordinal"), F.col("e.kind").alias("kind"))


def p4_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, field, clean_text, elements_kept, elements_left_out``: the clean text of each field, without the containers that lost."""
    from lectern.llm.markup import markup_to_text

    pages = latest(table(spark, sf_dir, "handwritten_pages"), ["page_id"], ["structured_markdown", "transcript"])
    kept = F.size(F.filter("elements", lambda e: e["kept"]))
    return markup_to_text(pages, "page_id", ["structured_markdown", "transcript"]).select(F.col("id").alias("page_id"), "field", "clean_text", kept.alias("elements_kept"), (F.size("elements") - kept).alias("elements_left_out"))


def _scans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    blocks = latest(table(spark, sf_dir, "ocr_blocks"), ["block_uid"], ["document_id", "page", "block_id", "block_type", "raw_text", "text"])
    pages = latest(table(spark, sf_dir, "handwritten_pages"), ["page_id"], ["source_file", "page_number", "transcript"])
    return blocks, pages


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.scans import scan_noise

    return scan_noise(*_scans(spark, sf_dir)).select("rec_kind", "rec_id", "line_no", "noise").distinct()


def p5_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.scans import repair_pages

    return repair_pages(*_scans(spark, sf_dir))


def language_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``table_name, rec_key, kind, text, lang`` (of the label; null for captions) of segments, pages and the chunks of videos, written once."""
    from lectern.llm.languages import canonical

    seg = latest(table(spark, sf_dir, "segments"), ["lecture_id", "segment_index"], ["language", "text"])
    seg = seg.select(F.lit("segments").alias("table_name"), F.concat_ws("#", "lecture_id", F.col("segment_index").cast("string")).alias("rec_key"), F.lit("speech").alias("kind"), "text", F.col("language").alias("label"))
    pages = latest(table(spark, sf_dir, "handwritten_pages"), ["page_id"], ["language", "transcript"])
    pages = pages.select(F.lit("handwritten_pages").alias("table_name"), F.col("page_id").cast("string").alias("rec_key"), F.lit("page").alias("kind"), F.col("transcript").alias("text"), F.col("language").alias("label"))
    # a video's label is joined to the sum over its chunks, one row a video, not to the chunks
    chunks = latest(table(spark, sf_dir, "youtube_chunks"), ["chunk_id"], ["video_id", "raw_text"])
    chunks = chunks.where(F.col("video_id").isNotNull()).select(F.lit("video_meta").alias("table_name"), F.col("video_id").alias("rec_key"), F.lit("caption").alias("kind"), F.col("raw_text").alias("text"), F.lit(None).cast("string").alias("label"))
    records = seg.unionByName(pages).unionByName(chunks)
    return materialize(records.select("table_name", "rec_key", "kind", "text", canonical(F.col("label")).alias("lang")), "language-records")


def languages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record: ``table_name, rec_key, lang`` (of the label), ``main, confidence, pieces``; videos by the words of all their chunks."""
    from lectern.llm.languages import LANGS, canonical, detect_languages, train

    records = language_records(spark, sf_dir)
    found = materialize(detect_languages(records, train(records)), "languages")
    short = found.where("table_name <> 'video_meta'").select("table_name", "rec_key", "lang", "main", "confidence", "pieces")
    sums = [F.sum(F.col("counts")[i]).alias(x) for i, x in enumerate(LANGS)]
    by_video = found.where("table_name = 'video_meta' and main is not null").groupBy("table_name", "rec_key").agg(*sums)
    labels = table(spark, sf_dir, "video_meta").groupBy("video_id").agg(F.max("transcript_language").alias("label"))
    by_video = by_video.join(labels.select(F.col("video_id").alias("rec_key"), canonical(F.col("label")).alias("lang")).hint("merge"), "rec_key")
    most = F.array_max(F.array(*[F.struct(F.col(x).alias("n"), F.lit(-i).alias("order"), F.lit(x).alias("x")) for i, x in enumerate(LANGS)]))
    total = sum((F.col(x) for x in LANGS[1:]), F.col(LANGS[0]))
    by_video = by_video.select("table_name", "rec_key", "lang", most["x"].alias("main"), (most["n"] / total).alias("confidence"), F.array().cast("array<struct<lang:string,words:int>>").alias("pieces"))
    return short.unionByName(by_video)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = languages_of(spark, sf_dir).where(F.col("main").isNotNull())
    wrong = found.where(~F.col("lang").eqNullSafe(F.col("main"))).select("table_name", "rec_key", F.lit(0).alias("piece"), F.col("main").alias("lang"))
    mixed = found.where(F.size("pieces") > 1).select("table_name", "rec_key", F.posexplode("pieces").alias("i", "p")).select("table_name", "rec_key", (F.col("i") + 1).alias("piece"), F.col("p.lang").alias("lang"))
    return wrong.unionByName(mixed).distinct()


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.languages import canonical, train
    from lectern.llm.pairs import pair_defects

    pairs = latest(table(spark, sf_dir, "chat_history"), ["id"], ["message", "response", "sources"], at="created_at")
    labelled = table(spark, sf_dir, "handwritten_pages").select(F.col("page_id").cast("string").alias("rec_key"), F.lit("page").alias("kind"), F.col("transcript").alias("text"), canonical(F.col("language")).alias("lang"))
    return pair_defects(pairs.where(F.col("id").isNotNull()), train(labelled, sample=10_000)).distinct()


def _capacities(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    windows = table(spark, sf_dir, "context_windows").where("window_name is not null and capacity_tokens > 0").limit(1001).collect()
    if len(windows) > 1000:
        raise ValueError("more than 1000 kinds of container")
    return {r["window_name"]: int(r["capacity_tokens"]) for r in windows}


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.packing import default_tokenizer, pack_documents, token_counts

    sized = token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), default_tokenizer(), out="size")
    packed = pack_documents(sized.select(F.col("doc_id").alias("item"), "size"), _capacities(spark, sf_dir))
    return packed.select("window", "container", F.col("item").cast("long").alias("doc_id"), "part", F.col("size").alias("tokens"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.packing import fill_report

    packed = p8_containers(spark, sf_dir).select("window", "container", F.col("doc_id").alias("item"), "part", F.col("tokens").alias("size"))
    return fill_report(packed, _capacities(spark, sf_dir))


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    from lectern.llm.languages import canonical
    from lectern.llm.mixing import mix_sources, smoothed
    from lectern.llm.packing import default_tokenizer, token_counts

    topics = table(spark, sf_dir, "courses").groupBy("course_id").agg(F.max("subject").alias("topic"))
    docs = token_counts(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "course_id", "text"), default_tokenizer())
    docs = docs.join(topics, "course_id", "left").select("doc_id", "source", canonical(F.col("lang")).alias("lang"), "topic", "tokens")
    return mix_sources(docs, table(spark, sf_dir, "mix_targets"), lang_targets=smoothed, topic_targets=smoothed, size=0.75)


def p9_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1]


def p9_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What source, language and topic were to have and reached."""
    return _mix(spark, sf_dir)[2]


def p9_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``too_many_copies, twice, unknown, off_target``: what must not be in a mix, counted over all its documents; the SQL twin says 0 for each."""
    docs, shares, _ = _mix(spark, sf_dir)
    limits = table(spark, sf_dir, "mix_targets").select("source", "max_repeats")
    known = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("own"))
    x = docs.groupBy("doc_id", "source").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).join(limits, "source", "left").join(known, "doc_id", "left")
    counts = x.agg(F.count_if(F.col("max_repeats").isNull() | (F.col("copies") > F.col("max_repeats"))).alias("too_many_copies"), F.count_if(F.col("rows") > 1).alias("twice"), F.count_if(~F.col("own").eqNullSafe(F.col("source"))).alias("unknown"))
    # shares relative to the sources that have documents, within two hundredths; one row per source, as many as mix_sources admits
    got = [r for r in shares.collect() if r["tokens"] > 0]
    able = sum(r["target_share"] for r in got)
    off = sum(abs(r["share"] - r["target_share"] / able) > 0.02 for r in got) if able else 0
    return counts.withColumn("off_target", F.lit(off).cast("long"))


def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each window, over all containers and documents: overfull containers, and documents cut needlessly; and how many documents are placed."""
    packed = p8_containers(spark, sf_dir)
    caps = spark.createDataFrame([(w, c) for w, c in _capacities(spark, sf_dir).items()], "window string, capacity int")
    full = packed.groupBy("window", "container").agg(F.sum("tokens").alias("held")).join(F.broadcast(caps), "window")
    full = full.groupBy("window").agg(F.count_if(F.col("held") > F.col("capacity")).alias("overfull"))
    cut = packed.groupBy("window", "doc_id").agg(F.count("*").alias("parts"), F.sum("tokens").alias("size"), F.max("tokens").alias("largest")).join(F.broadcast(caps), "window")
    cut = cut.groupBy("window").agg(F.count_if(F.col("parts") != F.ceil(F.col("size") / F.col("capacity"))).alias("cut_needlessly"), F.count("*").alias("documents"))
    return full.join(cut, "window").select("window", "overfull", "cut_needlessly", "documents")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.subjects import subject_shares, subjects_of

    shares = subject_shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_labels"), table(spark, sf_dir, "subject_areas"))
    return subjects_of(shares).select("doc_id", "subject")


QUERIES = {"p1_found": p1_found, "p1_turns": p1_turns, "p3_found": p3_found, "p3_groups": p3_groups, "p4_found": p4_found, "p4_clean": p4_clean, "p5_found": p5_found, "p5_repaired": p5_repaired, "p6_found": p6_found, "p7_found": p7_found, "p8_containers": p8_containers, "p8_fill": p8_fill, "p8_checks": p8_checks, "p9_documents": p9_documents, "p9_shares": p9_shares, "p9_margins": p9_margins, "p9_checks": p9_checks, "p10_found": p10_found}
P3_SQL = r"""
WITH c AS (SELECT chunk_id, coalesce(raw_text, '') || ' ' || coalesce(summary, '') AS t FROM (SELECT * FROM youtube_chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC NULLS LAST) = 1) WHERE chunk_id IS NOT NULL),
w AS (SELECT chunk_id, regexp_extract_all(lower(t), '[\p{L}\p{N}]+') AS w FROM c),
s AS (SELECT DISTINCT chunk_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT chunk_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
n AS (SELECT chunk_id, count(*) AS n FROM s GROUP BY chunk_id),
p AS (SELECT a.chunk_id AS chunk_id_a, b.chunk_id AS chunk_id_b, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.chunk_id < b.chunk_id GROUP BY ALL)
SELECT chunk_id_a, chunk_id_b FROM p JOIN n x ON x.chunk_id = chunk_id_a JOIN n y ON y.chunk_id = chunk_id_b WHERE 2 * shared >= x.n + y.n - shared
"""
P3_GROUPS_SQL = f"""
WITH RECURSIVE pairs AS MATERIALIZED ({P3_SQL}), edges AS (SELECT chunk_id_a AS u, chunk_id_b AS v FROM pairs UNION SELECT chunk_id_b, chunk_id_a FROM pairs),
reach AS (SELECT u AS chunk_id, u AS other FROM edges UNION SELECT r.chunk_id, e.v FROM reach r JOIN edges e ON e.u = r.other)
SELECT chunk_id, min(other) AS group_id FROM reach GROUP BY chunk_id
"""
SQL = {
    "p3_found": P3_SQL, "p3_groups": P3_GROUPS_SQL,
    # what must hold of any packing and any mix, whatever its order: every document with a token placed whole, none above its repeats
    "p8_checks": "SELECT window_name AS \"window\", 0::BIGINT AS overfull, 0::BIGINT AS cut_needlessly, (SELECT count(*) FROM documents WHERE length(text) > 0) AS documents FROM context_windows WHERE capacity_tokens > 0",
    "p9_checks": "SELECT 0::BIGINT AS too_many_copies, 0::BIGINT AS twice, 0::BIGINT AS unknown, 0::BIGINT AS off_target",
}
