"""Scalar text expressions shared by chunking, retrieval and evaluation: all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words left out of lexical matching.
STOP_WORDS = [
    "a", "an", "the", "is", "in", "on", "of", "to", "for", "and", "or", "with", "that", "this", "it", "as", "at", "be", "by", "from", "its", "was", "are", "were", "has", "have", "had", "not", "but",
    "can", "will", "just", "do", "did", "so", "if", "we", "you", "he", "she", "they", "what", "how", "why", "when", "where", "which", "who",
]
#: Words left out when answers are judged.
JUDGING_STOP_WORDS = [
    "a", "an", "the", "is", "in", "on", "of", "to", "for", "and", "or", "with", "that", "this", "it", "as", "at", "be", "by", "from", "its", "was", "are", "were", "has", "have", "had", "not", "but",
    "can", "will", "just", "do",
]


def _found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))


def tokens(text: Column, least: int = 2, letters_only: bool = False) -> Column:
    """For lexical matching: lower-case ASCII tokens of at least ``least`` characters, in order, with repeats, without stop words; [] for null."""
    return F.filter(_found(text, (r"[a-z]" if letters_only else r"[a-z0-9_]") + "{%d,}" % least), lambda t: ~t.isin(STOP_WORDS))


def judging_tokens(text: Column) -> Column:
    """For judging answers: the distinct tokens of three characters or more, without a shorter list of stop words."""
    return F.array_distinct(F.filter(_found(text, r"[a-z0-9_]{3,}"), lambda t: ~t.isin(JUDGING_STOP_WORDS)))


def plain_tokens(text: Column) -> Column:
    """For live judging: the distinct tokens of three letters or digits or more, none left out."""
    return F.array_distinct(_found(text, r"[a-z0-9]{3,}"))


def word_list(text: Column) -> Column:
    """Maximal runs without white space."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\S+"), F.lit(0))


def word_count(text: Column) -> Column:
    return F.size(word_list(text))


def token_estimate(text: Column) -> Column:
    """About 1.3 tokens a word, at least 1."""
    return F.greatest(F.lit(1), F.floor(word_count(text) * F.lit(1.3)).cast("int"))


def clean(text: Column) -> Column:
    """Without NUL, at most two line ends in a row, trimmed."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "\\x00", "")
    return F.trim(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def normalise_ocr(text: Column) -> Column:
    """CRLF to LF, words joined over hyphenated line ends, blanks squeezed."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n")
    t = F.regexp_replace(t, r"([A-Za-z])-\n([a-z])", "$1$2")
    return F.trim(F.regexp_replace(F.regexp_replace(t, "[ \t]+", " "), r"\n{3,}", "\n\n"))


def time_label(seconds: Column) -> Column:
    """MM:SS, or HH:MM:SS from an hour on; null, NaN and negative as 00:00."""
    s = F.when(seconds.isNull() | F.isnan(seconds) | (seconds < 0), F.lit(0)).otherwise(F.floor(seconds)).cast("long")
    h, m, r = F.floor(s / 3600).cast("long"), F.floor((s % 3600) / 60).cast("long"), s % 60
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    tail = F.concat(two(m), F.lit(":"), two(r))
    return F.when(h > 0, F.concat(F.when(h < 10, two(h)).otherwise(h.cast("string")), F.lit(":"), tail)).otherwise(tail)


def slug(text: Column, prefix: str, most: int = 45) -> Column:
    """``prefix-slug-hash``: lower case, runs of other characters as one dash, eight digits of the SHA-256, at most ``most`` long."""
    s = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    room = most - len(prefix) - 10
    return F.concat(F.lit(prefix + "-"), F.regexp_replace(F.substring(s, 1, room), "-+$", ""), F.lit("-"), F.substring(F.sha2(text, 256), 1, 8))


def video_id(url: Column) -> Column:
    """The 11-character id in any of four address forms, or the text itself if it is one; else null."""
    got = F.regexp_extract(url, r"(?:v=|youtu\.be/|embed/|shorts/)([A-Za-z0-9_-]{11})", 1)
    return F.when(got != "", got).when(url.rlike("^[A-Za-z0-9_-]{11}$"), url)


def query_hash(query: Column, mode: Column) -> Column:
    """SHA-256 of the squeezed lower-case query and the mode."""
    q = F.trim(F.regexp_replace(F.lower(query), r"\s+", " "))
    return F.sha2(F.concat(q, F.lit("|"), F.lower(mode)), 256)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 where either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def sentences(text: Column) -> Column:
    """Split behind . ! ? and white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")


def cited(text: Column) -> Column:
    """Distinct citation numbers in square brackets, in order of appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\[(\d{1,4})\]"), F.lit(1)), lambda x: x.cast("int")))
