"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells by source, language and topic (a fixed, small number; the table of cells is checked before it is used on the
driver). The token weight of each cell is raked in turn to the source, language and topic marginals, never above the source's
largest number of repeats; the source marginal is raked last, so it is the one that is met. The weight is the expected number of copies of
each document of the cell. Copies are drawn systematically: within shards of a cell, in order of size, so the tokens drawn follow the
weight closely; the largest documents are drawn first and the weights of the others calibrated to what is left. A document of more than half of what its source may give at all is not
drawn, since no draw could then meet the share.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import materialize

MOST_CELLS = 100_000


def rake(tokens: np.ndarray, keys: list[np.ndarray], targets: list[np.ndarray], caps: np.ndarray, total: float, rounds: int = 200) -> np.ndarray:
    """Weights so that ``tokens * weight`` has the marginals ``targets`` (shares of ``total``) over each of ``keys``, within ``caps``.

    The first marginal is met last in every round and afterwards alone, until no cell below its cap can be raised.
    """

    def fit(w: np.ndarray, k: np.ndarray, want: np.ndarray) -> np.ndarray:
        have = np.bincount(k, tokens * w, len(want))
        ratio = np.divide(want * total, have, out=np.zeros(len(want)), where=have > 0)
        return np.minimum(w * ratio[k], caps)

    w = np.minimum(np.ones(len(tokens)), caps)
    for _ in range(rounds):
        for k, want in list(zip(keys, targets))[::-1]:
            w = fit(w, k, want)
    for _ in range(60):
        w = fit(w, keys[0], targets[0])
    return w


def smoothed(shares: dict[str, float], power: float = 0.7) -> dict[str, float]:
    """Shares raised to a power below 1 and normalised: small parts gain, large ones lose."""
    raised = {k: v**power for k, v in shares.items() if v > 0}
    total = sum(raised.values())
    return {k: v / total for k, v in raised.items()}


def mix_sources(docs: DataFrame, targets: DataFrame, lang_targets=None, topic_targets=None, size: float = 1.0, shard_rows: int = 20_000, classes: tuple[float, ...] = (1 / 50, 1 / 200, 1 / 800), seed: int = 11) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents: ``doc_id, source, tokens, copies``; shares: ``source, target_share, max_repeats, documents, tokens, share``; margins: ``dimension, value,
    target_share, tokens, share``, the same for source, lang and topic).

    ``docs``: doc_id, source, lang, topic, tokens; ``targets``: source, target_share, max_repeats (one row per source, few).
    The mix is ``size`` of the largest at which every source that has tokens meets its share (relative to those sources) within its repeats; at the largest, a source that is
    used up leaves its languages and topics no room, so smaller mixes come nearer to those targets. A
    source without documents, or not in ``targets``, or null, gives nothing; null languages and topics are cells of their own; documents
    without tokens are never drawn. ``lang_targets`` and ``topic_targets`` are dictionaries of shares (values without documents are passed over, values not named get
    nothing), or functions from the documents' own shares to such a dictionary; without them the margin is that of the documents themselves. All three are raked in turn;
    where they cannot all be met within the repeats, the source's share is, and ``margins`` tells what the others reached.
    """
    spark = docs.sparkSession
    wanted = {r["source"]: (float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in targets.limit(MOST_CELLS + 1).collect() if r["source"] is not None}
    if len(wanted) > MOST_CELLS:
        raise ValueError("too many sources for one mix")
    blank = F.lit("")
    held = docs.join(F.broadcast(spark.createDataFrame([(s,) for s in wanted] or [("",)], "source string")), "source").where(F.col("tokens") > 0)
    held = materialize(held.select("doc_id", "source", F.coalesce("lang", blank).alias("lang"), F.coalesce("topic", blank).alias("topic"), F.col("tokens").cast("long").alias("tokens")), "mix-documents")
    cells = held.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    got = cells.limit(MOST_CELLS + 1).collect()
    if len(got) > MOST_CELLS:
        raise ValueError("too many cells: give coarser topics")
    schema = "doc_id bigint, source string, tokens bigint, copies int"
    if not got:
        empty = spark.createDataFrame([], schema)
        return empty, _shares(empty, targets), spark.createDataFrame([], "dimension string, value string, target_share double, tokens bigint, share double")
    tokens = np.array([r["tokens"] for r in got], float)
    keys, names = [], []
    for c in ("source", "lang", "topic"):
        names.append(sorted({r[c] for r in got}))
        at = {x: i for i, x in enumerate(names[-1])}
        keys.append(np.array([at[r[c]] for r in got]))
    share = np.array([wanted[s][0] for s in names[0]])
    share = share / share.sum() if share.sum() else share
    caps_of = np.array([wanted[s][1] for s in names[0]], float)
    have = np.bincount(keys[0], tokens, len(names[0]))
    able = share > 0
    total = float((have[able] * caps_of[able] / share[able]).min()) if able.any() else 0.0
    total *= size
    caps = caps_of[keys[0]]
    marginals = [share]
    for k, n, given in zip(keys[1:], names[1:], (lang_targets, topic_targets)):
        own = np.bincount(k, tokens * share[keys[0]] / np.maximum(have[keys[0]], 1), len(n))  # of a mix that meets the sources' shares
        own = own / own.sum() if own.sum() else own
        if given is not None:
            table = given(dict(zip(n, own))) if callable(given) else given
            wished = np.array([max(float(table.get(x, 0.0)), 0.0) for x in n])
            own = wished / wished.sum() if wished.sum() else own
        marginals.append(own)
    weight = rake(tokens, keys, marginals, caps, total)

    want = share * total

    def drawn(part: DataFrame, w: np.ndarray) -> DataFrame:
        """Copies of the documents of ``part`` with cell weights ``w``: systematic along the cells of each shard of a source."""
        rows = [(r["source"], r["lang"], r["topic"], float(w[i]), max(1, math.ceil(of_source[r["source"]] / shard_rows)), float(want[keys[0][i]] / 2)) for i, r in enumerate(got)]
        table = spark.createDataFrame(rows, "source string, lang string, topic string, weight double, shards int, most double")
        x = part.join(F.broadcast(table), ["source", "lang", "topic"])
        x = x.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("shards").cast("long")))
        start = F.pmod(F.xxhash64("source", "shard", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
        along = Window.partitionBy("source", "shard").orderBy("lang", "topic", "tokens", F.xxhash64("doc_id", F.lit(seed)), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
        x = x.withColumn("upto", F.sum("weight").over(along)).withColumn("u", start + 1e-9)
        copies = F.floor(F.col("upto") + F.col("u")) - F.floor(F.col("upto") - F.col("weight") + F.col("u"))
        copies = F.when(F.col("tokens") <= F.col("most"), copies).otherwise(0)
        return x.select("doc_id", "source", "lang", "topic", "tokens", F.least(copies, F.lit(int(caps_of.max()))).cast("int").alias("copies"))

    of_source: dict[str, int] = {}
    for r in got:
        of_source[r["source"]] = of_source.get(r["source"], 0) + r["n"]
    # documents of more than these parts of a source's share are drawn before the others, largest first
    level = F.lit(len(classes))
    for i, part in reversed(list(enumerate(classes))):
        bound = F.lit(0.0)
        for s, t in zip(names[0], want):
            bound = F.when(F.col("source") == s, F.lit(float(t * part))).otherwise(bound)
        level = F.when(F.col("tokens") > bound, F.lit(i)).otherwise(level)
    held = held.withColumn("level", level)
    sums = {(r["level"], r["source"], r["lang"], r["topic"]): float(r["t"]) for r in held.groupBy("level", "source", "lang", "topic").agg(F.sum("tokens").alias("t")).collect()}
    taken, out = np.zeros(len(names[0])), None
    for i in range(len(classes) + 1):
        part = materialize(drawn(held.where(F.col("level") == i), weight), f"mix-{i}")
        out = part if out is None else out.unionByName(part)
        for r in part.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("t")).collect():
            taken[names[0].index(r["source"])] += float(r["t"] or 0)
        rest = np.array([sum(sums.get((j, r["source"], r["lang"], r["topic"]), 0.0) for j in range(i + 1, len(classes) + 1)) for r in got])
        for _ in range(60):
            now = np.bincount(keys[0], rest * weight, len(names[0]))
            weight = np.minimum(weight * np.divide(np.maximum(want - taken, 0), now, out=np.ones(len(now)), where=now > 0)[keys[0]], caps)
    out = out.where("copies > 0")
    margins = [(d, x, float(t)) for d, n, m in zip(("source", "lang", "topic"), names, marginals) for x, t in zip(n, m)]
    reached = out.groupBy("source", "lang", "topic").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"))
    reached = reached.select("tokens", F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in ("source", "lang", "topic")])).alias("x"))
    reached = reached.groupBy("x.dimension", "x.value").agg(F.sum("tokens").alias("tokens"))
    reached = spark.createDataFrame(margins, "dimension string, value string, target_share double").join(reached, ["dimension", "value"], "left")
    share_of = F.col("tokens") / F.sum("tokens").over(Window.partitionBy("dimension"))  # one row per value
    reached = reached.select("dimension", "value", F.round("target_share", 6).alias("target_share"), F.coalesce("tokens", F.lit(0).cast("long")).alias("tokens"), F.round(F.coalesce(share_of, F.lit(0.0)), 6).alias("share"))
    out = out.select("doc_id", "source", "tokens", "copies")
    return out, _shares(out, targets), reached


def _shares(out: DataFrame, targets: DataFrame) -> DataFrame:
    used = out.groupBy("source").agg(F.count("*").alias("documents"), F.max("copies").alias("most_copies"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"))
    zero = F.lit(0).cast("long")
    x = targets.select("source", "target_share", "max_repeats").join(used, "source", "left")
    x = x.withColumn("all_tokens", F.sum("tokens").over(Window.partitionBy()))  # one row per source
    return x.select("source", "target_share", "max_repeats", F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.coalesce("documents", zero).alias("documents"), F.coalesce("tokens", zero).alias("tokens"), F.coalesce(F.round(F.col("tokens") / F.col("all_tokens"), 6), F.lit(0.0)).alias("share"))
