"""Records of the six kinds in one wide form, and what is shown of them: citation, display text, lexical text, context string."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.labels import citation_label

KINDS = ["documents", "qna", "audio", "youtube", "image", "handwritten"]
#: Columns of the wide form; a kind fills those it knows, the others are null.
WIDE = {
    "id": "string", "source_key": "string", "text": "string", "course_id": "string", "source_file": "string", "page_range": "string", "section_title": "string", "topic": "string", "summary": "string", "keywords": "string",
    "chunk_type": "string", "year_hint": "int", "marks_hint": "int", "image_type": "string", "image_summary": "string", "lecture_title": "string", "start_label": "string", "end_label": "string", "professor": "string",
    "week_number": "int", "video_title": "string", "chapter_title": "string", "deep_link": "string", "has_equations": "boolean", "has_diagrams": "boolean", "has_table": "boolean",
}


def widened(df: DataFrame, kind: str) -> DataFrame:
    """``df`` (some of the columns of ``WIDE``) with all of them, as records of one kind."""
    known = set(df.columns)
    return df.select(*[F.lit(kind).alias(c) if c == "source_key" else (F.col(c) if c in known else F.lit(None)).cast(t).alias(c) for c, t in WIDE.items()])


def _said(c: str) -> Column:
    """Null where blank."""
    return F.when(F.col(c) != "", F.col(c))


def record_citation() -> Column:
    """The citation of a wide record, in the form of its kind; parts that are missing are passed over."""
    pages = F.concat(F.lit("pp. "), _said("page_range"))
    kind_of_image = F.initcap(F.replace(_said("image_type"), F.lit("_"), F.lit(" ")))
    at = F.concat(F.lit("@ "), _said("start_label"))
    forms = {
        "qna": [F.coalesce(_said("source_file"), F.lit("Q&A Sheet")), pages, F.when(F.col("year_hint") != 0, F.col("year_hint").cast("string")), F.when(F.col("marks_hint") > 0, F.concat(F.lit("["), F.col("marks_hint").cast("string"), F.lit(" marks]")))],
        "image": [F.coalesce(_said("source_file"), F.lit("Scanned Material")), pages, kind_of_image],
        "audio": [F.coalesce(_said("lecture_title"), _said("source_file"), F.lit("Lecture")), F.concat(at, F.lit("–"), F.coalesce("end_label", F.lit(""))), _said("professor"), F.when(F.col("week_number") != 0, F.concat(F.lit("Week "), F.col("week_number").cast("string")))],
        "youtube": [F.coalesce(_said("video_title"), F.lit("YouTube Lecture")), at, F.when(F.col("chapter_title") != "Unknown", _said("chapter_title"))],
        "documents": [F.coalesce(_said("source_file"), F.lit("Course Document")), pages, F.concat(F.lit("§ "), _said("section_title"))],
        "handwritten": [F.coalesce(_said("source_file"), F.lit("Handwritten Notes")), F.concat(F.lit("p. "), _said("page_range")), _said("topic")],
    }
    out = F.coalesce(_said("source_file"), F.col("source_key"))
    for kind, parts in forms.items():
        out = F.when(F.col("source_key") == kind, citation_label(*parts)).otherwise(out)
    return out


def display_text(questions: Column | None = None, answers: Column | None = None) -> Column:
    """The text of a wide record as it is shown: numbered questions and answers, times, links, summaries in front."""
    text = F.coalesce("text", F.lit(""))
    asked = questions if questions is not None else F.array(text)
    said = answers if answers is not None else F.array().cast("array<string>")

    def numbered(items: Column, letter: str) -> Column:
        return F.transform(items, lambda x, i: F.concat(F.lit(letter), (i + 1).cast("string"), F.lit(": "), x))

    return (
        F.when(F.col("source_key") == "qna", F.array_join(F.concat(numbered(asked, "Q"), numbered(said, "A")), "\n"))
        .when((F.col("source_key") == "audio") & _said("start_label").isNotNull(), F.concat(F.lit("[Lecture @ "), F.col("start_label"), F.lit("–"), F.coalesce("end_label", F.lit("")), F.lit("]\n"), text))
        .when((F.col("source_key") == "youtube") & _said("deep_link").isNotNull(), F.concat(F.lit("[YouTube @ "), F.coalesce("start_label", F.lit("")), F.lit(" — "), F.col("deep_link"), F.lit("]\n"), text))
        .when((F.col("source_key") == "image") & _said("image_summary").isNotNull(), F.concat(F.lit("[Image: "), F.coalesce("image_type", F.lit("")), F.lit("]\nSummary: "), F.col("image_summary"), F.lit("\n\nExtracted text:\n"), text))
        .when((F.col("source_key") == "handwritten") & F.coalesce("has_equations", F.lit(False)), F.concat(F.lit("[has equations] "), text))
        .otherwise(text)
    )


def lexical_text() -> Column:
    """What lexical ranking reads of a wide record: for each kind the fields that hold its words, blanks left out."""
    fields = {"image": ["text", "image_summary", "topic", "keywords"], "handwritten": ["text", "topic", "summary"], "documents": ["text", "section_title", "keywords"]}
    out = F.coalesce("text", F.lit(""))
    for kind, names in fields.items():
        out = F.when(F.col("source_key") == kind, F.concat_ws(" ", *[_said(n) for n in names])).otherwise(out)
    return out


#: What a record of each kind must have when a live answer is judged.
REQUIRED = {
    "qna": ["chunk_type", "topic", "source_file"], "image": ["source_file", "course_id"], "audio": ["lecture_title"], "youtube": ["video_title", "deep_link"], "documents": ["source_file", "section_title"], "handwritten": ["source_file", "topic"],
}


def live_quality() -> tuple[Column, Column, Column]:
    """(completeness of required fields, whether 15 to 2,000 words, share of distinct words plus a tenth, at most 1) of a wide record."""
    complete = F.lit(1.0)
    for kind, names in REQUIRED.items():
        present = sum((_said(n).isNotNull().cast("int") for n in names[1:]), _said(names[0]).isNotNull().cast("int"))
        complete = F.when(F.col("source_key") == kind, F.round(present / len(names), 4)).otherwise(complete)
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"\S+"), F.lit(0))
    n = F.size(words)
    rich = F.when(n > 0, F.round(F.least(F.lit(1.0), F.size(F.array_distinct(words)) / n + 0.1), 4)).otherwise(0.0)
    return complete, (n >= 15) & (n <= 2000), rich


def context_strings(found: DataFrame, by: str) -> DataFrame:
    """``by, chunks, context``: the ranked records of each query (a top-k list) as numbered blocks with citation, type, score and methods, divided by a rule.

    ``found`` has ``by, rank, source_key, citation, chunk_type, score, methods, display``.
    """
    header = F.concat(
        F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.upper("source_key"), F.lit(" SOURCE\n     Citation : "), F.col("citation"), F.lit("\n     Type     : "), F.coalesce(_said("chunk_type"), F.lit("—")),
        F.lit("\n     Score    : "), F.col("score").cast("decimal(12,3)").cast("string"), F.lit("\n     Methods  : "), F.col("methods"), F.lit("\n\n"), F.trim("display"))
    blocks = F.array_sort(F.collect_list(F.struct("rank", header.alias("block"))))
    return found.groupBy(by).agg(F.count("*").alias("chunks"), F.concat(F.lit("\n"), F.array_join(F.transform(blocks, lambda b: b["block"]), "\n" + "─" * 65 + "\n")).alias("context"))
