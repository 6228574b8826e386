"""Question blocks of exam sheets and question lists as expressions: boundaries, answers, marks, year, difficulty, sub-parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How a question begins, how an answer begins, marks, difficulty words and what they stand for.
QUESTION = r"(?mi)^((?:(?:Q\.?\s*)?\d+[.)]\s|(?:Question|Ques|Q)\s*[:\-–—]?\s*\d*\s*[:\-–—]?\s))"
ANSWER = r"(?mi)^(?:Answer|Ans|A)\s*[:\-–—]?\s*\d*\s*[:\-–—]?\s+"
SOLUTION = r"(?mi)^Solution\s*[:\-–—]\s+"
MARKS = r"(?i)\[(\d{1,9})\s*(?:marks?|pts?|points?)\]"
YEAR = r"\b(?:19|20)\d{2}\b"
DIFFICULTY = r"(?i)\b(easy|medium|hard|difficult|simple|basic|advanced)\b"
MEANS = {"easy": "easy", "simple": "easy", "basic": "easy", "medium": "medium", "hard": "hard", "difficult": "hard", "advanced": "hard"}
SUB_PART = r"(?m)^\s*\(?[a-d]\)?[.)]\s"
LEAST_QUESTION, LEAST_PARAGRAPH = 15, 20


def stripped(t: Column) -> Column:
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def question_blocks(text: Column) -> Column:
    """The blocks of a text: from one question to the next (15 characters or more); without any question its paragraphs (20 or more)."""
    t = F.coalesce(text, F.lit(""))
    parts = F.split(F.regexp_replace(t, QUESTION, "\u0001$1"), "\u0001")
    asked = F.filter(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), stripped), lambda p: F.length(p) >= LEAST_QUESTION)
    plain = F.filter(F.transform(F.split(t, r"\n\s*\n"), stripped), lambda p: F.length(p) >= LEAST_PARAGRAPH)
    return F.when(F.size(parts) > 1, asked).otherwise(plain)


def block_fields(block: Column) -> Column:
    """question, answer ('' where none is marked), marks and year (null where none), difficulty, sub_parts."""
    rest = F.when(block.rlike(ANSWER), F.split(block, ANSWER, 2)).otherwise(F.split(block, SOLUTION, 2))
    years = F.regexp_extract_all(block, F.lit(YEAR), F.lit(0))
    marks, word = F.regexp_extract(block, MARKS, 1), F.lower(F.regexp_extract(block, DIFFICULTY, 1))
    level = F.lit("unknown")
    for w, kind in MEANS.items():
        level = F.when(word == w, kind).otherwise(level)
    return F.struct(
        stripped(rest[0]).alias("question"), F.when(F.size(rest) > 1, stripped(rest[1])).otherwise("").alias("answer"), F.when(marks != "", marks).cast("int").alias("marks"),
        F.when(F.size(years) > 0, F.element_at(years, -1)).cast("int").alias("year"), level.alias("difficulty"), block.rlike(SUB_PART).alias("sub_parts"))
