"""A rule planner for retrieval: per query, mode and category the budget and weight of each source, within the allowed ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weight of each source by mode.
WEIGHTS = {
    "ask": {"documents": 2.2, "qna": 2.0, "audio": 1.8, "handwritten": 1.3, "image": 1.2, "youtube": 1.0},
    "quiz": {"qna": 2.8, "documents": 1.8, "handwritten": 1.5, "image": 1.3, "audio": 1.0, "youtube": 0.8},
    "summarize": {"documents": 2.2, "audio": 2.0, "youtube": 1.8, "qna": 1.5, "handwritten": 1.3, "image": 1.2},
}
#: Factors by category of question.
ADJUSTMENTS = {
    "visual_or_diagram": {"image": 1.5, "youtube": 1.2},
    "problem_or_derivation": {"qna": 1.3, "handwritten": 1.4},
    "worked_example": {"handwritten": 1.5, "qna": 1.3, "audio": 1.2},
    "comparison": {"documents": 1.3, "youtube": 1.2},
    "procedural_steps": {"audio": 1.3, "youtube": 1.3},
}
#: Least and most dense candidates of each source, and its weight in lexical ranking.
DENSE_K = {"qna": (4, 8), "image": (3, 6), "audio": (6, 12), "youtube": (5, 8), "documents": (5, 9), "handwritten": (3, 6)}
LEXICAL = {"qna": 1.4, "image": 1.2, "documents": 1.2, "handwritten": 1.1, "audio": 0.9, "youtube": 0.8}
#: What a plan may hold.
RANGES = {"dense_k": (2, 20), "bm25_k": (0, 12), "mmr_k": (1, 15), "mmr_lambda": (0.3, 0.9), "priority_weight": (0.2, 3.0)}


def category_of(query: Column) -> Column:
    """A question's category by its words; 'general' otherwise."""
    q = F.lower(F.coalesce(query, F.lit("")))
    return (
        F.when(q.rlike(r"\b(?:difference|compare|versus|vs)\b"), "comparison").when(q.rlike(r"\b(?:diagram|figure|graph|plot|picture)\b"), "visual_or_diagram")
        .when(q.rlike(r"\b(?:derive|prove|solve|calculate)\b"), "problem_or_derivation").when(q.rlike(r"\bexample\b"), "worked_example").when(q.rlike(r"\b(?:steps?|procedure|how to)\b"), "procedural_steps").otherwise("general")
    )


def _rows() -> list:
    out = []
    for mode, weights in WEIGHTS.items():
        for category in [*ADJUSTMENTS, "general"]:
            for source, weight in weights.items():
                low, high = DENSE_K[source]
                k = (low + high) / 2 * (1.5 if mode == "quiz" and source == "qna" else 1.2 if mode == "summarize" else 1)
                w = min(max(weight * ADJUSTMENTS.get(category, {}).get(source, 1), RANGES["priority_weight"][0]), RANGES["priority_weight"][1])
                out.append((mode, category, source, int(min(max(k, RANGES["dense_k"][0]), RANGES["dense_k"][1])), round(w, 6), LEXICAL[source]))
    return out


def plan_budgets(queries: DataFrame) -> DataFrame:
    """``query_id, source, dense_k, priority_weight, lexical_weight``: six rows a query (``query_id, query, mode``); unknown modes as 'ask'."""
    rules = queries.sparkSession.createDataFrame(_rows(), "mode string, category string, source string, dense_k int, priority_weight double, lexical_weight double")
    mode = F.when(F.col("mode").isin(list(WEIGHTS)), F.col("mode")).otherwise("ask")
    # 108 fixed rows
    return queries.select("query_id", mode.alias("mode"), category_of(F.col("query")).alias("category")).join(F.broadcast(rules), ["mode", "category"]).select("query_id", "category", "source", "dense_k", "priority_weight", "lexical_weight")


def valid_budgets(budgets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(budgets within the ranges, those that are not with the names of the columns)."""
    from lectern.sources.files import split_rejects

    return split_rejects(budgets, {c: F.col(c).between(*RANGES[c]) for c in budgets.columns if c in RANGES})


#: Source, condition on its own columns, words one of which a plan's signals must hold (none: always), factor.
BOOSTS = [
    ("qna", "marks_hint > 0", (), 1.12),
    ("qna", "year_hint <> 0", (), 1.05),
    ("qna", "chunk_type IN ('single_qa', 'multi_qa')", ("exam", "question"), 1.10),
    ("handwritten", "has_equations", ("equation", "formula"), 1.15),
    ("handwritten", "content_type = 'equation'", (), 1.08),
    ("handwritten", "confidence < 0.6", (), 0.85),
    ("image", "ocr_confidence < 65", (), 0.80),
    ("image", "has_formula", ("formula", "equation"), 1.12),
    ("audio", "strategy = 'concept_block'", (), 1.08),
    ("audio", "avg_confidence < 0.7", (), 0.90),
    ("documents", "has_table", ("table", "comparison"), 1.10),
]


def source_boost(source: str, signals: tuple[str, ...] = ()) -> Column:
    """Factor of a record of ``source`` by its metadata columns and the signals a plan values; a null condition does not hold."""
    from lectern.functions.labels import metadata_boost

    valued = " ".join(signals).lower()
    return metadata_boost([(F.expr(condition), factor) for s, condition, words, factor in BOOSTS if s == source and (not words or any(w in valued for w in words))])
