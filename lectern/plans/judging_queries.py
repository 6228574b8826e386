"""Question blocks and the judging of answers, plans and lists over the test tables, with SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import cited, plain_tokens, sentences, word_count
from lectern.operators.planning import WEIGHTS, category_of, plan_budgets
from lectern.operators.qna import ANSWER, DIFFICULTY, MARKS, MEANS, QUESTION, SOLUTION, SUB_PART, YEAR, block_fields, question_blocks
from lectern.plans.evaluation_queries import LATEST_CHAT, _answers, completeness_average
from lectern.session import latest, table


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("source in ('exam_sheet', 'forum_answer')")
    x = d.select("doc_id", F.posexplode(question_blocks(F.col("text"))).alias("position", "block"))
    return x.select("doc_id", "position", F.length("block").alias("chars"), block_fields(F.col("block")).alias("f")).select("doc_id", "position", "chars", "f.*")


def qna_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of exam sheets and forum answers with their fields; no hint of marks or year is -1."""
    b = _blocks(spark, sf_dir)
    return b.select("doc_id", "position", F.sha2("question", 256).alias("question_hash"), F.sha2("answer", 256).alias("answer_hash"), F.coalesce("marks", F.lit(-1)).alias("marks"), F.coalesce("year", F.lit(-1)).alias("year"), "difficulty", "sub_parts")


_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_LEVEL = "CASE lower(regexp_extract(block, '" + DIFFICULTY + "', 1)) " + " ".join(f"WHEN '{w}' THEN '{k}'" for w, k in MEANS.items()) + " ELSE 'unknown' END"
BLOCKS_CTE = (
    rf"""d AS (SELECT doc_id, coalesce(text, '') AS t, string_split(regexp_replace(coalesce(text, ''), '{QUESTION}', chr(1) || '\1', 'g'), chr(1)) AS parts FROM documents WHERE source IN ('exam_sheet', 'forum_answer')),
l AS (SELECT doc_id, CASE WHEN len(parts) > 1 THEN list_filter(list_transform(parts[2:], lambda p: {_STRIP.format('p')}), lambda p: length(p) >= 15) ELSE list_filter(list_transform(string_split_regex(t, '\n\s*\n'), lambda p: {_STRIP.format('p')}), lambda p: length(p) >= 20) END AS b FROM d),
e AS (SELECT doc_id, unnest(range(len(b))) AS position, unnest(b) AS block FROM l),
a AS (SELECT *, string_split(CASE WHEN regexp_matches(block, '{ANSWER}') THEN regexp_replace(block, '{ANSWER}', chr(2)) ELSE regexp_replace(block, '{SOLUTION}', chr(2)) END, chr(2)) AS qa FROM e),
blocks AS (SELECT doc_id, position::INT AS position, length(block) AS chars, {_STRIP.format('qa[1]')} AS question, CASE WHEN len(qa) > 1 THEN {_STRIP.format("array_to_string(qa[2:], chr(2))")} ELSE '' END AS answer,
 TRY_CAST(nullif(regexp_extract(block, '{MARKS}', 1), '') AS INT) AS marks, regexp_extract_all(block, '{YEAR}')[-1]::INT AS year, {_LEVEL} AS difficulty, regexp_matches(block, '{SUB_PART}') AS sub_parts FROM a)"""
)
QNA_SQL = f"WITH {BLOCKS_CTE} SELECT doc_id, position, sha256(question) AS question_hash, sha256(answer) AS answer_hash, coalesce(marks, -1) AS marks, coalesce(year, -1) AS year, difficulty, sub_parts FROM blocks"


def qna_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all blocks as chunks of one question: presence of answers, marks, years, sub-parts, and sizes in estimated tokens (a quarter of the characters)."""
    b = _blocks(spark, sf_dir)
    rate = lambda c: F.round(F.avg(c.cast("double")), 4)
    size = F.floor(F.col("chars") / 4)
    return b.groupBy("difficulty").agg(F.count("*").alias("chunks"), rate(F.col("answer") != "").alias("answer_rate"), rate(F.col("marks").isNotNull()).alias("marks_rate"), rate(F.col("year").isNotNull()).alias("year_rate"), rate(F.col("sub_parts")).alias("sub_part_rate"),
                                       F.min(size).alias("least"), F.max(size).alias("most"), rate(size < 20).alias("under_rate"), rate(size > 800).alias("over_rate"))


QNA_EVAL_SQL = f"""WITH {BLOCKS_CTE} SELECT difficulty, count(*) AS chunks, round(avg((answer <> '')::INT), 4) AS answer_rate, round(avg((marks IS NOT NULL)::INT), 4) AS marks_rate, round(avg((year IS NOT NULL)::INT), 4) AS year_rate, round(avg(sub_parts::INT), 4) AS sub_part_rate,
 min(chars // 4)::BIGINT AS least, max(chars // 4)::BIGINT AS most, round(avg((chars // 4 < 20)::INT), 4) AS under_rate, round(avg((chars // 4 > 800)::INT), 4) AS over_rate FROM blocks GROUP BY difficulty"""

#: The mix of difficulties a quiz aims at.
TARGET_DIFFICULTY = {"easy": 0.3, "medium": 0.5, "hard": 0.2}


def difficulty_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per sheet: distance (sum of absolute differences, at most 1) between the difficulties of its questions and the aimed mix; sheets without questions do not occur."""
    n = _blocks(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("questions"), *[F.count_if(F.col("difficulty") == k).alias(k) for k in [*TARGET_DIFFICULTY, "unknown"]])
    off = F.col("unknown") / F.col("questions")
    for k, want in TARGET_DIFFICULTY.items():
        off = off + F.abs(F.lit(want) - F.col(k) / F.col("questions"))
    return n.select("doc_id", "questions", F.round(F.least(off, F.lit(1.0)), 6).alias("error"))


DIFFICULTY_SQL = f"""WITH {BLOCKS_CTE}, c AS (SELECT doc_id, count(*) AS questions, """ + ", ".join(f"count(*) FILTER (difficulty = '{k}') AS {k}" for k in [*TARGET_DIFFICULTY, "unknown"]) + """ FROM blocks GROUP BY doc_id)
SELECT doc_id, questions, round(least(unknown / questions""" + "".join(f" + abs({v}::DOUBLE - {k} / questions)" for k, v in TARGET_DIFFICULTY.items()) + ", 1.0), 6) AS error FROM c"

#: Marks that an answer of a format shows, and the words an answer of a length may have.
FORMAT_SIGNALS = {
    "structured_explanation": [r"##\s+", r"\*\*", r"\n\n"],
    "definition_then_example": [r"(?:defined as|definition|means that)", r"(?:for example|e\.g\.|instance)"],
    "comparison_table": [r"\|.*\|", r"vs\.?\s", r"compared to"],
    "worked_solution": [r"(?:step \d|given:|find:|solution:)", r"=\s*\d"],
    "quiz_questions": [r"^\d+[.)]\s", r"(?:answer|correct answer|explanation):"],
    "topic_summary": [r"##\s+", r"overview|summary|key points"],
    "bullet_summary": [r"^[\-\*]\s", r"•\s"],
}
LENGTHS = {"short": (40, 350), "medium": (200, 900), "long": (500, 3000)}


def expected_format(message: Column) -> Column:
    m = F.coalesce(message, F.lit(""))
    return F.when(m.startswith("Summary"), "topic_summary").when(m.startswith("Flashcards"), "quiz_questions").when(m.contains("difference"), "comparison_table").when(m.startswith("Explain"), "structured_explanation").when(m.contains("example"), "definition_then_example").when(m.startswith("Can you summarise"), "bullet_summary").when(m.startswith("How"), "worked_solution").otherwise("conceptual_prose")


def plan_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per answer: the format its message asks for, the share of that format's marks it shows (1 where it has none), its words, and whether their number fits a short answer."""
    h = latest(table(spark, sf_dir, "chat_history"), ["id"], ["message", "response"], at="created_at").withColumn("format", expected_format(F.col("message")))
    answer, score = F.coalesce("response", F.lit("")), F.lit(1.0)
    for name, patterns in FORMAT_SIGNALS.items():
        hits = sum((answer.rlike("(?mi)" + p).cast("int") for p in patterns[1:]), answer.rlike("(?mi)" + patterns[0]).cast("int"))
        score = F.when(F.col("format") == name, F.round(hits / len(patterns), 6)).otherwise(score)
    n = word_count(F.col("response"))
    return h.select("id", "format", score.alias("alignment"), n.alias("words"), n.between(*LENGTHS["short"]).alias("length_ok"))


_WORDS = r"len(regexp_extract_all(coalesce(response, ''), '[^ \t\n\r\f\x0B]+'))"
ALIGN_SQL = f"""WITH h AS (SELECT id, coalesce(message, '') AS m, coalesce(response, '') AS r, response FROM {LATEST_CHAT}),
f AS (SELECT *, CASE WHEN m LIKE 'Summary%' THEN 'topic_summary' WHEN m LIKE 'Flashcards%' THEN 'quiz_questions' WHEN contains(m, 'difference') THEN 'comparison_table' WHEN m LIKE 'Explain%' THEN 'structured_explanation' WHEN contains(m, 'example') THEN 'definition_then_example' WHEN m LIKE 'Can you summarise%' THEN 'bullet_summary' WHEN m LIKE 'How%' THEN 'worked_solution' ELSE 'conceptual_prose' END AS format FROM h)
SELECT id, format, CASE format """ + " ".join(f"WHEN '{n}' THEN round((" + " + ".join(f"regexp_matches(r, '(?mi){p}')::INT" for p in ps) + f") / {len(ps)}, 6)" for n, ps in FORMAT_SIGNALS.items()) + f" ELSE 1.0 END::DOUBLE AS alignment, {_WORDS}::INT AS words, {_WORDS} BETWEEN 40 AND 350 AS length_ok FROM f"


def live_faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per answer with sources: sentences of more than 15 characters that share no token with the previews, citations per source, share of the message's tokens found in the answer."""
    a = _answers(spark, sf_dir).where(F.size("items") > 0)
    context = plain_tokens(F.array_join(F.transform("items", lambda i: F.coalesce(i["preview"], F.lit(""))), " "))
    said = F.filter(F.transform(F.split(F.coalesce("response", F.lit("")), "[.!?]"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: F.length(s) > 15)
    x = a.select("id", "items", "message", "response", context.alias("c"), said.alias("s"))
    bare = F.size(F.filter("s", lambda s: ~F.arrays_overlap(plain_tokens(s), F.col("c"))))
    wanted, low = plain_tokens(F.col("message")), F.lower(F.coalesce("response", F.lit("")))
    found = F.size(F.filter(wanted, lambda w: F.contains(low, w)))
    return x.select("id", F.when(F.size("s") > 0, F.round(bare / F.size("s"), 4)).otherwise(0.0).alias("hallucination"), F.round(F.size(cited(F.col("response"))) / F.size("items"), 4).alias("citation_density"), F.when(F.size(wanted) > 0, F.round(found / F.size(wanted), 4)).otherwise(1.0).alias("keyword_recall"))


_PLAIN = "list_distinct(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]{{3,}}'))"
LIVE_FAITH_SQL = f"""WITH a AS (SELECT id, message, response, try_cast(CASE WHEN json_valid(sources) THEN json_extract(sources, '$.items[*]') END AS JSON[]) AS items FROM {LATEST_CHAT}),
x AS (SELECT id, len(items) AS k, {_PLAIN.format("array_to_string(list_transform(items, lambda i: coalesce(i ->> 'preview', '')), ' ')")} AS c, lower(coalesce(response, '')) AS low, {_PLAIN.format('message')} AS w,
 list_filter(list_transform(string_split_regex(coalesce(response, ''), '[.!?]'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: length(s) > 15) AS s, len(list_distinct(regexp_extract_all(coalesce(response, ''), '\\[(\\d{{1,4}})\\]', 1))) AS cites FROM a WHERE len(items) > 0)
SELECT id, CASE WHEN len(s) > 0 THEN round(len(list_filter(s, lambda y: NOT list_has_any({_PLAIN.format('y')}, c))) / len(s), 4) ELSE 0 END::DOUBLE AS hallucination, round(cites / k, 4)::DOUBLE AS citation_density, CASE WHEN len(w) > 0 THEN round(len(list_filter(w, lambda z: contains(low, z))) / len(w), 4) ELSE 1 END::DOUBLE AS keyword_recall FROM x"""


def live_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: averages of the live measures over all answers with sources, and whether each and all are within their limits."""
    f = live_faithfulness(spark, sf_dir).agg(F.count("*").alias("scenarios"), *[F.round(F.sum(F.round(F.col(c) * 10000).cast("long")) / F.count("*") / 10000, 4).alias(c) for c in ("hallucination", "citation_density", "keyword_recall")])
    x = f.crossJoin(F.broadcast(completeness_average(spark, sf_dir)))  # one row each
    ok = (F.col("hallucination") < 0.45) & (F.col("completeness") >= 0.70)
    return x.select("scenarios", "hallucination", "citation_density", "keyword_recall", "completeness", (F.col("hallucination") < 0.45).alias("faithfulness_ok"), (F.col("completeness") >= 0.70).alias("chunking_ok"), ok.alias("passed"))


LIVE_HEALTH_SQL = f"""WITH f AS ({LIVE_FAITH_SQL}), h AS (SELECT count(*) AS scenarios, """ + ", ".join(f"round(sum(round({c} * 10000)::BIGINT) / count(*) / 10000, 4)::DOUBLE AS {c}" for c in ("hallucination", "citation_density", "keyword_recall")) + """ FROM f)
SELECT h.*, completeness, hallucination < 0.45 AS faithfulness_ok, completeness >= 0.7 AS chunking_ok, hallucination < 0.45 AND completeness >= 0.7 AS passed FROM h, (SELECT round(avg(presence), 4) AS completeness FROM (@COMPLETE@))"""

#: What a plan should and should not weigh for each mode, for judging plans.
EXPECTED = {"ask": (["documents", "qna", "audio"], []), "quiz": (["qna", "documents"], ["youtube"]), "summarize": (["documents", "audio"], ["image"])}


def selection_scores(planned: Column, expected: Column, excluded: Column) -> tuple[Column, Column]:
    """(precision less the share of excluded ones, recall) of the sources planned; 0 and 0 where none is planned, recall 1 where none is expected."""
    n, hit = F.size(planned), F.size(F.array_intersect(planned, expected))
    precision = F.greatest(F.lit(0.0), (hit - F.size(F.array_intersect(planned, excluded))) / F.greatest(n, F.lit(1)))
    recall = F.when(F.size(expected) > 0, hit / F.greatest(F.size(expected), F.lit(1))).otherwise(1.0)
    return F.when(n > 0, F.round(precision, 4)).otherwise(0.0), F.when(n > 0, F.round(recall, 4)).otherwise(0.0)


def planner_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions by mode and category: how the sources weighed 1.5 or more match those expected of the mode."""
    h = latest(table(spark, sf_dir, "chat_history"), ["id"], ["message"], at="created_at")
    mode = F.when(F.col("message").startswith("Summary"), "summarize").when(F.col("message").startswith("Flashcards"), "quiz").otherwise("ask")
    q = h.select(F.col("id").alias("query_id"), F.col("message").alias("query"), mode.alias("mode"))
    n = q.groupBy("mode", category_of(F.col("query")).alias("category")).agg(F.count("*").alias("questions"), F.min(F.struct("query_id", "query")).alias("one"))
    plans = plan_budgets(n.select(F.col("one.query_id").alias("query_id"), F.col("one.query").alias("query"), "mode"))
    heavy = plans.groupBy("query_id").agg(F.array_sort(F.collect_list(F.when(F.col("priority_weight") >= 1.5, F.col("source")))).alias("planned"))
    x = n.join(heavy, F.col("one.query_id") == F.col("query_id"))
    lit = lambda i: F.element_at(F.create_map(*[c for m, e in EXPECTED.items() for c in (F.lit(m), F.array(*map(F.lit, e[i])).cast("array<string>"))]), F.col("mode"))
    precision, recall = selection_scores(F.col("planned"), lit(0), lit(1))
    return x.select("mode", "category", "questions", F.array_join("planned", "+").alias("planned"), precision.alias("precision"), recall.alias("recall"))


def _selection_sql() -> str:
    from lectern.operators.planning import _rows

    rules = ", ".join(f"('{m}', '{c}', '{s}', {w})" for m, c, s, _, w, _ in _rows())
    wanted = ", ".join(f"('{m}', {e}::VARCHAR[], {x}::VARCHAR[])" for m, (e, x) in EXPECTED.items())
    return f"""
WITH r(mode, category, source, w) AS (VALUES {rules}), x(mode, want, avoid) AS (VALUES {wanted}),
q AS (SELECT CASE WHEN message LIKE 'Summary%' THEN 'summarize' WHEN message LIKE 'Flashcards%' THEN 'quiz' ELSE 'ask' END AS mode, lower(coalesce(message, '')) AS m FROM {LATEST_CHAT}),
c AS (SELECT mode, CASE WHEN regexp_matches(m, '\\b(?:difference|compare|versus|vs)\\b') THEN 'comparison' WHEN regexp_matches(m, '\\b(?:diagram|figure|graph|plot|picture)\\b') THEN 'visual_or_diagram'
 WHEN regexp_matches(m, '\\b(?:derive|prove|solve|calculate)\\b') THEN 'problem_or_derivation' WHEN regexp_matches(m, '\\bexample\\b') THEN 'worked_example' WHEN regexp_matches(m, '\\b(?:steps?|procedure|how to)\\b') THEN 'procedural_steps' ELSE 'general' END AS category FROM q),
n AS (SELECT mode, category, count(*) AS questions FROM c GROUP BY ALL), p AS (SELECT mode, category, list(source ORDER BY source) FILTER (w >= 1.5) AS planned FROM r GROUP BY ALL)
SELECT mode, category, questions, array_to_string(planned, '+') AS planned, round(greatest(0, (len(list_intersect(planned, want)) - len(list_intersect(planned, avoid))) / len(planned)), 4)::DOUBLE AS precision, round(len(list_intersect(planned, want)) / len(want), 4)::DOUBLE AS recall
FROM n JOIN p USING (mode, category) JOIN x USING (mode)"""


def mode_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the weights follow the mode, over the plans of all questions: questions weigh more in a quiz, documents in a summary, videos less in a quiz; a third of a point each."""
    h = latest(table(spark, sf_dir, "chat_history"), ["id"], ["message"], at="created_at")
    one = h.groupBy(category_of(F.col("message")).alias("category")).agg(F.count("*").alias("n"), F.min(F.struct("id", "message")).alias("one"))
    q = one.select(F.col("one.id").alias("id"), F.col("one.message").alias("query"), "n", F.explode(F.array(*map(F.lit, WEIGHTS))).alias("mode"))
    b = plan_budgets(q.select(F.concat_ws("#", "id", "mode").alias("query_id"), "query", "mode")).join(q.select(F.concat_ws("#", "id", "mode").alias("query_id"), "mode", "n"), "query_id")
    mean = lambda m, s: F.sum(F.when((F.col("mode") == m) & (F.col("source") == s), F.col("priority_weight") * F.col("n"))) / F.sum(F.when((F.col("mode") == m) & (F.col("source") == s), F.col("n")))
    x = b.agg(F.round(mean("quiz", "qna") - mean("ask", "qna"), 6).alias("quiz_qna"), F.round(mean("summarize", "documents") - mean("quiz", "documents"), 6).alias("summary_documents"), F.round(mean("ask", "youtube") - mean("quiz", "youtube"), 6).alias("quiz_youtube"))
    points = (F.col("quiz_qna") >= 0.3).cast("int") + (F.col("summary_documents") >= 0.2).cast("int") + (F.col("quiz_youtube") >= 0.1).cast("int")
    return x.select("quiz_qna", "summary_documents", "quiz_youtube", F.round(points / 3, 6).alias("score"))


def _mode_sql() -> str:
    from lectern.operators.planning import _rows

    rules = ", ".join(f"('{m}', '{c}', '{s}', {w})" for m, c, s, _, w, _ in _rows())
    mean = lambda m, s: f"sum(w * n) FILTER (mode = '{m}' AND source = '{s}') / sum(n) FILTER (mode = '{m}' AND source = '{s}')"
    return f"""
WITH r(mode, category, source, w) AS (SELECT mode, category, source, w::DOUBLE FROM (VALUES {rules}) v(mode, category, source, w)), q AS (SELECT lower(coalesce(message, '')) AS m FROM {LATEST_CHAT}),
c AS (SELECT CASE WHEN regexp_matches(m, '\\b(?:difference|compare|versus|vs)\\b') THEN 'comparison' WHEN regexp_matches(m, '\\b(?:diagram|figure|graph|plot|picture)\\b') THEN 'visual_or_diagram'
 WHEN regexp_matches(m, '\\b(?:derive|prove|solve|calculate)\\b') THEN 'problem_or_derivation' WHEN regexp_matches(m, '\\bexample\\b') THEN 'worked_example' WHEN regexp_matches(m, '\\b(?:steps?|procedure|how to)\\b') THEN 'procedural_steps' ELSE 'general' END AS category, count(*) AS n FROM q GROUP BY ALL),
d AS (SELECT round({mean('quiz', 'qna')} - {mean('ask', 'qna')}, 6) AS quiz_qna, round({mean('summarize', 'documents')} - {mean('quiz', 'documents')}, 6) AS summary_documents, round({mean('ask', 'youtube')} - {mean('quiz', 'youtube')}, 6) AS quiz_youtube FROM r JOIN c USING (category))
SELECT *, round(((quiz_qna >= 0.3)::INT + (summary_documents >= 0.2)::INT + (quiz_youtube >= 0.1)::INT) / 3, 6)::DOUBLE AS score FROM d"""


def attribution_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per answer with citations: entropy of its citation numbers against the most it could be (0 for one number), and the share of its sentences of four words or more that cite."""
    h = latest(table(spark, sf_dir, "chat_history"), ["id"], ["response"], at="created_at")
    n = h.select("id", F.explode(F.regexp_extract_all("response", F.lit(r"\[(\d{1,4})\]"), F.lit(1))).alias("c")).groupBy("id", "c").agg(F.count("*").alias("n"))
    t = n.groupBy("id").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.sum(F.col("n") * F.log2("n")).alias("nlogn"))
    entropy = F.when(F.col("kinds") > 1, (F.log2("total") - F.col("nlogn") / F.col("total")) / F.log2("kinds")).otherwise(0.0)
    said = F.filter(sentences(F.col("response")), lambda s: word_count(s) >= 4)
    share = h.select("id", said.alias("s")).select("id", F.when(F.size("s") > 0, F.round(F.size(F.filter("s", lambda s: s.rlike(r"\[\d+\]"))) / F.size("s"), 6)).otherwise(0.0).alias("cited_sentences"))
    return t.join(share, "id").select("id", "total", "kinds", F.round(entropy, 6).alias("balance"), "cited_sentences")


# behind . ! ? and white space, without looking back: the mark is kept by a sign set after it
BALANCE_SQL = f"""WITH h AS (SELECT id, coalesce(response, '') AS r FROM {LATEST_CHAT}), n AS (SELECT id, c, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(r, '\\[(\\d{{1,4}})\\]', 1)) AS c FROM h) GROUP BY ALL),
t AS (SELECT id, sum(n)::BIGINT AS total, count(*) AS kinds, sum(n * log2(n)) AS nlogn FROM n GROUP BY id),
s AS (SELECT id, list_filter(string_split(regexp_replace(r, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: len(regexp_extract_all(x, '[^ \\t\\n\\r\\f\\x0B]+')) >= 4) AS s FROM h)
SELECT t.id, total, kinds, round(CASE WHEN kinds > 1 THEN (log2(total) - nlogn / total) / log2(kinds) ELSE 0 END, 6)::DOUBLE AS balance, CASE WHEN len(s) > 0 THEN round(len(list_filter(s, lambda x: regexp_matches(x, '\\[\\d+\\]'))) / len(s), 6) ELSE 0 END::DOUBLE AS cited_sentences FROM t JOIN s ON s.id = t.id"""

QUERIES = {
    "qna_blocks": qna_blocks, "qna_evaluation": qna_evaluation, "difficulty_error": difficulty_error, "plan_alignment": plan_alignment, "live_faithfulness": live_faithfulness, "live_health": live_health, "planner_selection": planner_selection,
    "mode_adaptation_score": mode_checks, "attribution_balance": attribution_balance,
}


def _sql() -> dict[str, str]:
    from lectern.plans.evaluation_queries import COMPLETE_SQL

    return {
        "qna_blocks": QNA_SQL, "qna_evaluation": QNA_EVAL_SQL, "difficulty_error": DIFFICULTY_SQL, "plan_alignment": ALIGN_SQL, "live_faithfulness": LIVE_FAITH_SQL, "live_health": LIVE_HEALTH_SQL.replace("@COMPLETE@", COMPLETE_SQL),
        "planner_selection": _selection_sql(), "mode_adaptation_score": _mode_sql(), "attribution_balance": BALANCE_SQL,
    }


SQL = _sql()
