"""Labels and classifications of content: code language, block type, section titles, citation labels, boosts, source inference."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks of programming languages, in the order that breaks ties; all without regard to case, ^ and $ at line ends.
CODE_MARKS = {
    "python": [r"\bdef\s+\w+\s*\(", r"\bclass\s+\w+[\s:(]", r"\bimport\s+\w+", r"\bfrom\s+\w+\s+import", r"\bif\s+__name__\s*==", r":\s*$", r"\bprint\s*\(", r"\bself\.", r"->\s*\w+:", r"#.*$"],
    "java": [r"\bpublic\s+(static\s+)?(class|void|int|String)", r"\bprivate\s+\w+\s+\w+", r"\bSystem\.out\.print", r"@Override", r"@Autowired", r"\bnew\s+\w+\s*\(", r"import\s+java\.", r";\s*$"],
    "cpp": [r"#include\s*[<\"]", r"\bstd::", r"\bcout\s*<<", r"\bcin\s*>>", r"\busing\s+namespace\s+std", r"\bvoid\s+\w+\s*\(", r"->\w+", r"::\w+"],
    "c": [r"#include\s*[<\"]", r"\bprintf\s*\(", r"\bscanf\s*\(", r"\bmalloc\s*\(", r"\bfree\s*\(", r"\bint\s+main\s*\(", r"\*\w+"],
    "javascript": [
        r"\bconst\s+\w+\s*=", r"\blet\s+\w+\s*=", r"\bvar\s+\w+\s*=", r"\bfunction\s+\w+\s*\(", r"=>\s*\{", r"\bconsole\.log\s*\(", r"===", r"!==", r"\bpromise\b", r"\basync\b", r"\bawait\b", r"document\.", r"window\.",
    ],
    "sql": [r"\bSELECT\b.*\bFROM\b", r"\bINSERT\s+INTO\b", r"\bUPDATE\b.*\bSET\b", r"\bDELETE\s+FROM\b", r"\bCREATE\s+(TABLE|DATABASE|INDEX)\b", r"\bWHERE\b", r"\bJOIN\b", r"\bGROUP\s+BY\b"],
    "bash": [r"^\s*#!.*/(bash|sh|zsh)", r"\becho\s+", r"\bexport\s+", r"\$\w+", r"\|\s*\w+", r"chmod\s+", r"sudo\s+", r"&&\s*\n", r"\\\s*\n"],
    "pseudocode": [
        r"\bBEGIN\b", r"\bEND\b", r"\bIF\b.*\bTHEN\b", r"\bELSE\b", r"\bFOR\b.*\bDO\b", r"\bWHILE\b.*\bDO\b", r"\bRETURN\b", r"\bPRINT\b", r"←", r"\bPROCEDURE\b", r"\bFUNCTION\b",
    ],
}


def _score(text: Column, patterns: list[str]) -> Column:
    out = F.lit(0)
    for p in patterns:
        out = out + F.regexp_count(text, F.lit("(?mi)" + p))
    return out


def code_language(text: Column) -> Column:
    """The language with the most marks, at least two; ties to the first listed; 'unknown' otherwise and for null."""
    best = F.array_max(F.array(*[F.struct(_score(text, ps).alias("n"), F.lit(-i).alias("order"), F.lit(name).alias("name")) for i, (name, ps) in enumerate(CODE_MARKS.items())]))
    return F.coalesce(F.when(best["n"] >= 2, best["name"]), F.lit("unknown"))


def is_section_title(line: Column) -> Column:
    """At most 110 characters, no . , ; at the end, and numbered, or beginning like a chapter, or at most ten words all in capitals or each with a capital."""
    t = F.trim(line)
    short = (F.length(t) > 0) & (F.length(t) <= 110) & ~t.rlike(r"[.,;]$")
    numbered = t.rlike(r"^(?:\d+(?:\.\d+)*[.)]?\s+\S|(?i:chapter|unit|section|part|lecture|lesson|module|topic|slide)\b)")
    # each run of letters begins with a capital and goes on in small letters
    titled = t.rlike(r"[A-Z]") & ~t.rlike(r"(?:^|[^A-Za-z])[a-z]|[A-Za-z][A-Z]")
    return F.coalesce(short & (numbered | ((F.size(F.split(t, r"\s+")) <= 10) & (((F.upper(t) == t) & t.rlike("[A-Z]")) | titled))), F.lit(False))


def block_type(text: Column, is_code: Column, y: Column, page_height: Column) -> Column:
    """code, formula (two or more signs), list_item, heading (top 15 % and short), caption (bottom 15 % and short), paragraph or unknown."""
    t = F.trim(F.coalesce(text, F.lit("")))
    place = y / page_height
    return (
        F.when(t == "", "unknown").when(F.coalesce(is_code, F.lit(False)), "code").when(F.regexp_count(t, F.lit(r"[=+∑∫√≤≥^]")) >= 2, "formula").when(t.rlike(r"^(?:[-*•]|\d{1,3}[.)])\s+\S"), "list_item")
        .when((place < 0.15) & (F.length(t) <= 80) & ~t.rlike(r"[.]$"), "heading").when((place > 0.85) & (F.length(t) <= 120), "caption").otherwise("paragraph")
    )


def page_label(first: Column, last: Column) -> Column:
    """'a–b', or 'a' where both are equal or one is missing; null for none."""
    a, b = F.coalesce(first, last), F.coalesce(last, first)
    return F.when(a == b, a.cast("string")).otherwise(F.concat(a.cast("string"), F.lit("–"), b.cast("string")))


def citation_label(*parts: Column) -> Column:
    """The parts that are not null or blank, joined by a middle dot."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (F.trim(p) != "")), " · ")


def metadata_boost(rules: list[tuple[Column, float]]) -> Column:
    """The product of the factors whose condition holds; a null condition does not."""
    out = F.lit(1.0)
    for condition, factor in rules:
        out = out * F.when(condition, F.lit(factor)).otherwise(1.0)
    return out


#: The kind of a record by the names of its metadata, first rule first; the values a field must have, where its name alone does not tell.
SOURCE_MARKS = [
    ("youtube", ["video_id", "deep_link"], None, []),
    ("handwritten", ["ink_quality", "writing_style", "model_used"], None, []),
    ("audio", [], "strategy", ["sliding_window", "concept_block", "lecture_summary"]),
    ("image", ["gemini_summary", "gemini_topic", "ocr_confidence"], None, []),
    ("qna", ["year_hint"], "chunk_type", ["single_qa", "multi_qa", "passage"]),
]


def infer_source(meta: Column) -> Column:
    """The kind of a record from its metadata (map of names to values), by ``SOURCE_MARKS``; documents where no rule holds, and for null."""
    out = F.lit("documents")
    for kind, names, field, values in reversed(SOURCE_MARKS):
        told = F.arrays_overlap(F.map_keys(meta), F.array(*map(F.lit, names))) if names else F.lit(False)
        if field:
            told = told | F.coalesce(F.try_element_at(meta, F.lit(field)).isin(values), F.lit(False))
        out = F.when(F.coalesce(told, F.lit(False)), kind).otherwise(out)
    return out
