"""Hybrid retrieval as DataFrames: dense top-k in blocks, BM25, diversity selection, rank fusion, query cache, metadata filters."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import tokens
from lectern.session import materialize


def metadata_filter(conditions: dict) -> Column:
    """A conjunction from ``{column: value}`` or ``{column: {"$eq" | "$ne" | "$gt" | "$gte" | "$lt" | "$lte" | "$in": value}}``."""
    out = F.lit(True)
    for name, want in conditions.items():
        for op, value in (want.items() if isinstance(want, dict) else [("$eq", want)]):
            c = F.col(name)
            match op:
                case "$eq":
                    out &= c == value
                case "$ne":
                    out &= c != value
                case "$gt":
                    out &= c > value
                case "$gte":
                    out &= c >= value
                case "$lt":
                    out &= c < value
                case "$lte":
                    out &= c <= value
                case "$in":
                    out &= c.isin(list(value))
                case _:
                    raise ValueError(f"unknown operator {op}")
    return out


def _unit_blocks(vectors: DataFrame, buckets: int, rows: int) -> DataFrame:
    """``bucket, ids, m``: unit vectors gathered into blocks of at most ``rows`` (64-bit row-major matrix as bytes), each of one of ``buckets`` drawn by id."""

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for bucket, part in pdf.groupby("bucket"):
                for low in range(0, len(part), rows):
                    some = part.iloc[low : low + rows]
                    m = np.stack(some["vector"].to_numpy()).astype(np.float64)
                    norm = np.linalg.norm(m, axis=1, keepdims=True)
                    m = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
                    whole = np.isfinite(m).all(axis=1)  # a vector that is not is like nothing
                    yield pd.DataFrame({"bucket": [bucket], "ids": [some["id"].to_numpy()[whole]], "m": [m[whole].tobytes()]})

    drawn = vectors.where("vector is not null and id is not null").select(F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int").alias("bucket"), "id", "vector")
    return drawn.mapInPandas(gather, "bucket int, ids array<bigint>, m binary")


def _nearest(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, billionths) of the k greatest of each row of finite or -inf scores, compared in whole billionths; of equal ones the first columns."""
    n = min(k, s.shape[1])
    # what may round to the k-th score or above, ties and all; the exact order decides among these
    cut = np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n] - 2e-9
    row, col = np.nonzero((s >= cut[:, None]) & (s > -np.inf))
    near = np.floor(s[row, col] * 1e9 + 0.5).astype(np.int64)
    order = np.lexsort((col, -near, row))
    row, col, near = row[order], col[order], near[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k], near[place < k]


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int, block_rows: int = 32768, query_rows: int = 512, count: int | None = None, exclude_self: bool = True) -> DataFrame:
    """``query_id, id, score, rank``: the k nearest by cosine of every query among all vectors, itself excluded unless ``exclude_self`` is false.

    Vectors are dealt to buckets of about ``block_rows`` or fewer, one bucket a task; blocks of queries stream past each bucket, and a query leaves k rows there. Nothing is joined:
    a task holds its bucket and one block of queries, the vectors move once, the queries once a bucket. Ties (in whole billionths) go to the smaller id; a zero vector
    has score 0; null vectors are left out. The work is the product of both counts, as a stated query set against all rows needs. ``count``: how many
    vectors there are about, where that is known (else they are counted).
    """
    count = vectors.count() if count is None else count
    buckets = max(1, -(-count // block_rows), min(-(-count // 1024), int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    every = F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket")
    a = _unit_blocks(queries, 1, query_rows).select(every, F.lit(1).alias("asks"), "ids", "m")
    b = _unit_blocks(vectors, buckets, block_rows).select("bucket", F.lit(0).alias("asks"), "ids", "m")

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []
        ids = m = None
        for pdf in batches:
            for asks, some, block in zip(pdf["asks"], pdf["ids"], pdf["m"]):
                some = np.asarray(some)
                if not len(some):
                    continue
                if not asks:
                    held.append((some, np.frombuffer(block).reshape(len(some), -1)))
                    continue
                if ids is None and held:
                    ids, m = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
                    order = np.argsort(ids, kind="stable")
                    ids, m, held = ids[order], m[order].T.copy(), []
                if ids is None:
                    break  # an empty bucket
                q = np.frombuffer(block).reshape(len(some), -1)
                step = max(1, 2_000_000 // len(ids))
                for low in range(0, len(some), step):
                    asked = some[low : low + step]
                    s = q[low : low + step] @ m
                    if exclude_self:
                        at = np.searchsorted(ids, asked)
                        until = np.searchsorted(ids, asked, side="right")
                        for i in np.nonzero(until > at)[0]:
                            s[i, at[i] : until[i]] = -np.inf
                    row, col, near = _nearest(s, k)
                    yield pd.DataFrame({"query_id": asked[row], "id": ids[col], "score": s[row, col], "near": near})

    found = a.unionByName(b).repartitionById(buckets, F.col("bucket")).sortWithinPartitions("asks").mapInPandas(multiply, "query_id bigint, id bigint, score double, near bigint")
    w = Window.partitionBy("query_id").orderBy(F.col("near").desc(), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("near")


def dense_topk_of_texts(vectors: DataFrame, asked: DataFrame, k: int, embed: Callable[[DataFrame], DataFrame], count: int | None = None) -> DataFrame:
    """As ``dense_topk`` for ``asked`` (query_id, text), but a text that many ask is embedded and searched once. ``embed`` adds ``vector`` to ``id, text``."""
    texts = asked.groupBy("text").agg(F.min("query_id").alias("id"))
    found = dense_topk(vectors, embed(texts.select("id", "text")).select("id", "vector"), k + 1, count=count, exclude_self=False)
    # one more than k, since each asker leaves itself out
    askers = asked.select("query_id", "text").join(texts, "text").select("query_id", F.col("id").alias("as"))
    out = askers.join(found.withColumnRenamed("query_id", "as"), "as").where(F.col("query_id") != F.col("id"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("rank") <= k).select("query_id", "id", "score", "rank")


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, shard_rows: int = 4096) -> DataFrame:
    """``query_id, id, score, rank``: BM25 within a group, scores divided by the query's best (by 1 if that is not positive).

    ``docs``: grp, id (unique in its group), text; ``queries``: query_id (asks one group), grp, text. Terms in more than half of a group's documents have a negative
    idf, which is replaced by ``epsilon`` times the group's mean idf. Every occurrence of a query term counts; documents without a
    query term are not ranked. Document frequencies are one sum by (group, term). Documents then move once, as tokens, to shards of about ``shard_rows`` of their group; a shard is
    indexed in memory, the group's queries stream past it, and each leaves its k best and what may tie with them, so matches of terms and documents are never rows.
    """
    listed = docs.where("grp is not null").select("grp", "id", tokens(F.col("text")).alias("t"))
    # a row a distinct term, and one that is the document's length behind a blank; written once, since three sums read it
    counted = F.explode(F.concat(F.array_distinct("t"), F.array(F.concat(F.lit(" "), F.size("t").cast("string"))))).alias("term")
    df = materialize(listed.select("grp", counted).groupBy("grp", "term").agg(F.count("*").alias("df")), "document-frequencies")
    length = F.startswith("term", F.lit(" "))
    stats = df.where(length).groupBy("grp").agg(F.sum("df").alias("n"), (F.sum(F.col("df") * F.trim("term").cast("long")) / F.sum("df")).alias("avg_len"))
    idf = df.where(~length).select("grp", "term", "df").join(stats, "grp").withColumn("idf", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    mean = idf.groupBy("grp").agg(F.avg("idf").alias("mean_idf"))
    asked = queries.select("query_id", "grp", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "grp", "term").agg(F.count("*").alias("qtf"))
    asked = asked.join(idf, ["grp", "term"]).join(mean, "grp").withColumn("idf", F.when(F.col("idf") < 0, epsilon * F.col("mean_idf")).otherwise(F.col("idf")))
    asked = asked.groupBy("query_id", "grp", "n", "avg_len").agg(F.array_sort(F.collect_list(F.struct("term", (F.col("qtf") * F.col("idf")).alias("w")))).alias("q"))

    shards = F.ceil(F.col("n") / shard_rows).cast("int")
    # groups of more than one shard only: at most one in ``shard_rows`` documents
    large = F.broadcast(stats.where(shards > 1).select("grp", shards.alias("shards")))
    docs_at = listed.join(large, "grp", "left").select("grp", F.coalesce(F.pmod(F.xxhash64("id"), F.col("shards")).cast("int"), F.lit(0)).alias("shard"), F.lit(0).alias("asks"), "id", F.array_join("t", " ").alias("words"))
    asks_at = asked.select("grp", F.explode(F.sequence(F.lit(0), shards - 1)).alias("shard"), F.lit(1).alias("asks"), "query_id", F.array_join(F.col("q.term"), " ").alias("words"), F.col("q.w").alias("w"), "avg_len")
    both = docs_at.unionByName(asks_at, allowMissingColumns=True).repartition("grp", "shard").sortWithinPartitions("grp", "shard", "asks")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, index = None, [], None
        for batch in batches:
            grp, shard, asks = (batch.column(c).to_pylist() for c in ("grp", "shard", "asks"))
            found: list = []
            low = 0
            while low < len(asks):
                high = low
                while high < len(asks) and (grp[high], shard[high], asks[high]) == (grp[low], shard[low], asks[low]):
                    high += 1
                if (grp[low], shard[low]) != at:
                    at, held, index = (grp[low], shard[low]), [], None
                part = batch.slice(low, high - low)
                if not asks[low]:
                    held.append(part.select(["id", "words"]))
                elif held or index:
                    index = index or _Index(held)
                    held = []
                    for i, (words, w) in enumerate(zip(part.column("words").to_pylist(), part.column("w").to_pylist())):
                        rows, raw = index.best(words.split(" "), w, part.column("avg_len")[i].as_py(), k, k1, b)
                        found.append((part.column("query_id").slice(i, 1), index.ids.take(pa.array(rows)), raw))
                low = high
            if found:
                n = pa.array(np.repeat(np.arange(len(found)), [len(raw) for _, _, raw in found]))
                ids, query_ids = pa.concat_arrays([i for _, i, _ in found]), pa.concat_arrays([q for q, _, _ in found]).take(n)
                yield pa.RecordBatch.from_arrays([query_ids, ids, pa.array(np.concatenate([raw for _, _, raw in found]))], names=["query_id", "id", "raw"])

    kind = queries.schema["query_id"].dataType.simpleString(), docs.schema["id"].dataType.simpleString()
    scored = both.mapInArrow(rank, f"query_id {kind[0]}, id {kind[1]}, raw double")
    per = Window.partitionBy("query_id")
    best = F.max("raw").over(per)
    scored = scored.withColumn("score", F.round(F.col("raw") / F.when(best > 0, best).otherwise(1.0), 6))
    return scored.withColumn("rank", F.row_number().over(per.orderBy(F.col("score").desc(), "id"))).where(F.col("rank") <= k).select("query_id", "id", "score", "rank")


class _Index:
    """Term frequencies of one shard's documents, in order of id; built from record batches of ``id, words`` (tokens with blanks between)."""

    def __init__(self, parts: list[pa.RecordBatch]):
        held = pa.Table.from_batches(parts).combine_chunks()
        held = held.take(pc.sort_indices(held, sort_keys=[("id", "ascending")]))
        self.ids = held.column("id").combine_chunks()
        words = pc.split_pattern(held.column("words").combine_chunks(), " ")
        self.len = pc.if_else(pc.equal(held.column("words"), ""), 0, pc.list_value_length(words)).to_numpy().astype(float)
        known = pc.list_flatten(words).dictionary_encode()
        n = len(self.ids)
        cell, self.tf = np.unique(known.indices.to_numpy().astype(np.int64) * n + pc.list_parent_indices(words).to_numpy(), return_counts=True)
        self.doc, self.at = cell % n, np.searchsorted(cell, np.arange(len(known.dictionary) + 1) * n)
        self.code = {t: i for i, t in enumerate(known.dictionary.to_pylist())}

    def best(self, terms: list[str], w: list[float], avg_len: float, k: int, k1: float, b: float) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of a query's k best, and of those that may round to the score of the last of them; of exactly equal scores the first k."""
        parts, gains, most = [], [], 1.0
        for term, weight in zip(terms, w):
            if (c := self.code.get(term)) is not None:
                doc, tf = self.doc[self.at[c] : self.at[c + 1]], self.tf[self.at[c] : self.at[c + 1]]
                parts.append(doc)
                gains.append(weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * self.len[doc] / avg_len)))
            most += max(weight, 0.0) * (k1 + 1)
        if not parts:
            return np.empty(0, np.int64), np.empty(0)
        rows, place = np.unique(np.concatenate(parts), return_inverse=True)
        raw = np.bincount(place, weights=np.concatenate(gains))
        if len(raw) > k:
            # scores are rounded to millionths of the query's best, which is below ``most``
            keep = raw >= np.partition(raw, len(raw) - k)[len(raw) - k] - 1.01e-6 * most
            rows, raw = rows[keep], raw[keep]
            order = np.lexsort((rows, -raw))
            rows, raw = rows[order], raw[order]
            equal = np.arange(len(raw)) - np.searchsorted(-raw, -raw)
            rows, raw = rows[equal < k], raw[equal < k]
        return rows, raw


def reciprocal_rank_fusion(lists: DataFrame, k: int, constant: int = 60) -> DataFrame:
    """``query_id, id, rrf, methods, rank`` from ``query_id, id, method, rank, weight`` and, if there are, ``boost`` and ``meta``.

    Score: sum of weight * boost / (constant + rank); a null boost is 1.
    """
    boost = F.coalesce(F.col("boost"), F.lit(1.0)) if "boost" in lists.columns else F.lit(1.0)
    # of a record's metadata those of the list named first are kept
    meta = [F.min_by("meta", F.struct("method", "rank")).alias("meta")] if "meta" in lists.columns else []
    fused = lists.groupBy("query_id", "id").agg(F.round(F.sum(F.col("weight") * boost / (constant + F.col("rank"))), 9).alias("rrf"), F.array_join(F.array_sort(F.collect_set("method")), "+").alias("methods"), *meta)
    w = Window.partitionBy("query_id").orderBy(F.col("rrf").desc(), "id")
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mmr_select(candidates: DataFrame, k: int, lam: float = 0.6, strict_same_file: bool = False) -> DataFrame:
    """``query_id, id, pick``: greedy choice of k by ``lam * relevance - (1 - lam) * nearest chosen``.

    ``candidates``: query_id, id, score, file, position; a query has a bounded list (a top-k result). Two candidates of one file are alike by 0.85
    within two positions and 0.5 otherwise; others by the product of their scores. Missing files count as one file unless
    ``strict_same_file``. Lists of at most k keep their order.
    """

    def choose(pdf: pd.DataFrame) -> np.ndarray:
        s, f, p = pdf["score"].to_numpy(float), pdf["file"].fillna("").to_numpy(), pdf["position"].to_numpy(float)
        if len(s) <= k:
            return np.arange(len(s))
        same = f[:, None] == f[None, :]
        if strict_same_file:
            same &= (f != "")[:, None]
        sim = np.where(same, np.where(np.abs(p[:, None] - p[None, :]) <= 2, 0.85, 0.5), s[:, None] * s[None, :])
        picked, near = [0], sim[0].copy()
        while len(picked) < k:
            gain = lam * s - (1 - lam) * near
            gain[picked] = -np.inf
            picked.append(int(gain.argmax()))
            near = np.maximum(near, sim[picked[-1]])
        return np.array(picked)

    def lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # sorted by list, so a batch holds whole lists but for its last, which waits for the next
        rest = None
        for pdf in itertools.chain(batches, [None]):
            if pdf is not None and not len(pdf):
                continue
            have = rest if pdf is None else pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if have is None:
                return
            starts = np.flatnonzero(have["number"].to_numpy() == 1)
            ends = [*starts[1:], *([len(have)] if pdf is None else [])]
            rest = have.iloc[starts[-1] :].reset_index(drop=True)
            rows = [low + choose(have.iloc[low:high]) for low, high in zip(starts, ends)]
            if rows:
                chosen = have.iloc[np.concatenate(rows)][["query_id", "id"]]
                yield chosen.assign(pick=np.concatenate([np.arange(1, len(r) + 1) for r in rows]))

    kind = candidates.schema["query_id"].dataType.simpleString(), candidates.schema["id"].dataType.simpleString()
    # lists are told apart by the first row of each, whatever the type of their key
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    ranked = candidates.withColumn("number", F.row_number().over(w))
    return ranked.select("query_id", "id", "score", "file", "position", "number").mapInPandas(lists, f"query_id {kind[0]}, id {kind[1]}, pick int")


def keep_newest(entries: DataFrame, bucket: list[str], created: str, tie: str, most: int) -> DataFrame:
    """First in, first out: the newest ``most`` entries of each bucket.

    A pre-selection within salted shards bounds what a bucket's ranking sees, so a bucket with a third of all rows costs ``16 * most`` rows.
    """
    newest = [F.col(created).desc(), F.col(tie).desc()]
    salted = Window.partitionBy(*bucket, "__salt").orderBy(*newest)
    x = entries.withColumn("__salt", F.pmod(F.xxhash64(tie), F.lit(16))).withColumn("__r", F.row_number().over(salted)).where(F.col("__r") <= most)
    return x.withColumn("__r", F.row_number().over(Window.partitionBy(*bucket).orderBy(*newest))).where(F.col("__r") <= most).drop("__salt", "__r")
