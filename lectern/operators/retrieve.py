"""Retrieval end to end as one plan: budgets, dense lists by namespace, diversity selection, BM25 over what dense search found, boosted rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.boundary import call_model, hashed_embedding
from lectern.operators.planning import BOOSTS, LEXICAL, plan_budgets, source_boost
from lectern.operators.retrieval import bm25_topk, dense_topk, mmr_select, reciprocal_rank_fusion
from lectern.session import materialize

#: Dense search fetches this many times its budget for the lexical ranking of what it finds, but no more than the limit; candidates kept by diversity.
FETCH, FETCH_LIMIT, MMR_K, MMR_LAMBDA, LEXICAL_K = 3, 40, 8, 0.6, 6


def retrieve(records: DataFrame, queries: DataFrame, k: int = 8, signals: tuple[str, ...] = (), embed=hashed_embedding) -> DataFrame:
    """``query_id, id, source_key, rrf, methods, rank``: the k best records of each query over all namespaces.

    ``records``: id (bigint), source_key, text, source_file, position, and the columns that ``planning.BOOSTS`` names (missing ones do not count);
    ``queries``: query_id (bigint), query, mode. Each query is planned by its words; its dense list of a namespace has three times the budget, at most 40;
    lists longer than the diversity budget are thinned; BM25 ranks the survivors of each list among themselves; both kinds of list are fused with the plan's weights and
    the records' boosts. Null texts are embedded as ''. Queries of equal words and mode are answered once. The only work that grows with both sides is the dense search, in blocks.
    """
    vector = lambda df: call_model(df.withColumn("text", F.coalesce("text", F.lit(""))), "text", embed, "array<double>", "vector").select("id", "vector")
    known = set(records.columns)
    boost = F.lit(1.0)
    from pyspark.sql import Column

    for source in {b[0] for b in BOOSTS}:
        usable = all(c in known for c in _columns(source))
        factor: Column = source_boost(source, signals) if usable else F.lit(1.0)
        boost = F.when(F.col("source_key") == source, factor).otherwise(boost)
    held = materialize(records.select("id", "source_key", "text", "source_file", "position", boost.alias("boost")), "records")

    # equal queries have equal lists, but a query that is a record leaves itself out
    own = queries.select("query_id", "query", "mode").join(held.select(F.col("id").alias("query_id"), F.lit(True).alias("own")).distinct(), "query_id", "left")
    alike = Window.partitionBy("query", "mode", F.when(F.col("own"), F.col("query_id")))
    askers = materialize(own.withColumn("as", F.min("query_id").over(alike)).drop("own"), "askers")
    queries = askers.where(F.col("query_id") == F.col("as")).select("query_id", "query", "mode")
    budgets = materialize(plan_budgets(queries), "budgets")
    asked = materialize(vector(queries.select(F.col("query_id").alias("id"), F.col("query").alias("text"))), "query-vectors")
    fetch = F.least(F.col("dense_k") * FETCH, F.lit(FETCH_LIMIT))

    dense = None
    rows = {r["source_key"]: r["count"] for r in held.groupBy("source_key").count().where(F.col("source_key").isin(list(LEXICAL))).collect()}
    for source, longest in sorted(map(tuple, budgets.groupBy("source").agg(F.max(fetch)).collect())):
        # six namespaces; within each the list is as long as the query's own budget
        top = dense_topk(vector(held.where(F.col("source_key") == source).select("id", "text")), asked, longest, count=rows.get(source, 0)).withColumn("source", F.lit(source))
        dense = top if dense is None else dense.unionByName(top)
    if dense is None:  # nobody asks
        return queries.sparkSession.createDataFrame([], "query_id bigint, id bigint, source_key string, rrf double, methods string, rank int")
    found = dense.join(budgets, ["query_id", "source"]).where(F.col("rank") <= fetch).join(held.select("id", "source_file", "position", "boost"), "id")
    found = materialize(found.select("query_id", "source", "id", "score", "rank", "priority_weight", "lexical_weight", "source_file", "position", "boost"), "dense-found")

    # both kinds of list are per (query, namespace)
    key = F.concat_ws("#", F.col("query_id").cast("string"), F.col("source"))
    picks = mmr_select(found.select(key.alias("query_id"), "id", "score", F.col("source_file").alias("file"), "position"), MMR_K, MMR_LAMBDA).select(F.col("query_id").alias("list"), "id", "pick")
    kept = found.withColumn("list", key).join(picks, ["list", "id"]).drop("source_file", "position")
    kept = materialize(kept.join(held.select("id", "text"), "id"), "kept")
    words = queries.select("query_id", "query")
    lists = kept.select("list", "query_id").distinct().join(words, "query_id").select(F.col("list").alias("grp"), F.xxhash64("list").alias("query_id"), F.col("query").alias("text"))
    lexical = bm25_topk(kept.select(F.col("list").alias("grp"), "id", "text"), lists, LEXICAL_K).withColumnRenamed("query_id", "at").withColumnRenamed("rank", "place").select("at", "id", "place")
    lexical = kept.withColumn("at", F.xxhash64("list")).join(lexical, ["at", "id"])
    a = kept.select("query_id", "id", F.when(F.col("pick") == F.col("rank"), "dense").otherwise("mmr").alias("method"), F.col("pick").alias("rank"), F.col("priority_weight").alias("weight"), "boost", F.col("source").alias("meta"))
    b = lexical.select("query_id", "id", F.lit("bm25").alias("method"), F.col("place").alias("rank"), (F.col("priority_weight") * F.col("lexical_weight")).alias("weight"), "boost", F.col("source").alias("meta"))
    fused = reciprocal_rank_fusion(a.unionByName(b), k).withColumnRenamed("query_id", "as")
    return askers.select("query_id", "as").join(fused, "as").select("query_id", "id", F.col("meta").alias("source_key"), "rrf", "methods", "rank")


def _columns(source: str) -> set[str]:
    import re

    words = {w for s, condition, _, _ in BOOSTS if s == source for w in re.findall(r"[a-z_]+", re.sub(r"'[^']*'", "", condition))}
    return words - {"in"}
