"""Near-duplicate records by MinHash candidates, Bayesian pruning and exact verification.

1. Records of the same word sequence form one class; a class is one representative, so copies cost nothing further.
2. MinHash values of word shingles are drawn per class; ``bands`` groups of ``rows`` values are band keys. Classes that share
   a key are candidate pairs (found by a join on the key, never by collecting a bucket; the join's skewed partitions are split when it runs).
3. The lowest bit of every MinHash value is kept as a sketch. A candidate's sketches are compared 64 values at a time; after
   each step the posterior probability that the similarity reaches the threshold, given the matches so far and a uniform
   prior, is compared with ``tolerance``, and the pair is dropped when it is below. The least admissible match counts are
   computed once, so each step is a bit count and a comparison. The first step is a condition of the join itself, so that pairs dropped there
   are never made.
4. What is left is verified on the shingle sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.session import materialize


def words(text: Column) -> Column:
    """Runs of letters and digits, lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


class WordHashes(dict):
    """64-bit hashes of the words met so far; forgotten beyond ``most``."""

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def shingles(self, text: str, k: int, most: int = 1_000_000) -> np.ndarray:
        """Hashes of the runs of ``k`` words of a text whose words stand between blanks (repeated runs come repeatedly)."""
        if len(self) > most:
            self.clear()
        h = np.fromiter(map(self.__getitem__, text.split(" ")), np.uint64)
        n = len(h) - k + 1
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out = _mix((out + h[j : j + n]) * np.uint64(0x9E3779B97F4A7C15))
        return out


@lru_cache(4)
def _coefficients(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint64).astype(np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def minhash(hashes: np.ndarray, n: int, seed: int) -> np.ndarray:
    """``n`` MinHash values (32 bits) of a set of 64-bit hashes."""
    a, b = _coefficients(n, seed)
    h = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(n, np.uint32(2**32 - 1))
    for low in range(0, len(h), 1024):
        out = np.minimum(out, (h[low : low + 1024, None] * a + b).min(axis=0))
    return out


def _signed(k: int, bands: int, rows: int, seed: int):
    n = bands * rows

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for whole in batches:
            for low in range(0, len(whole), 1000):
                pdf = whole[low : low + 1000]
                v = np.stack([minhash(known.shingles(t, k), n, seed) for t in pdf["text"]]).astype(np.uint64)
                key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(pdf), bands))
                for r in range(rows):
                    key = _mix((key * np.uint64(0x9E3779B97F4A7C15)) ^ v[:, r::rows])
                bits = np.packbits((_mix(v) & np.uint64(1)).astype(np.uint8), axis=1)
                bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8)))
                yield pd.DataFrame({"cls": pdf["cls"].to_numpy(), "keys": list(key.view(np.int64)), "sketch": list(bits.view(">i8").astype(np.int64))})

    return sign


def _shingle_sets(k: int):
    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for whole in batches:
            for low in range(0, len(whole), 1000):
                pdf = whole[low : low + 1000]
                yield pd.DataFrame({"cls": pdf["cls"].to_numpy(), "shingles": [np.unique(known.shingles(t, k)).view(np.int64) for t in pdf["text"]]})

    return sets


def least_matches(threshold: float, tolerance: float, steps: list[int]) -> list[int]:
    """For n one-bit values, the fewest matches at which P(similarity >= threshold | matches) >= tolerance (uniform prior)."""
    j = (np.arange(20_000) + 0.5) / 20_000
    p = (1 + j) / 2
    out = []
    for n in steps:
        for m in range(n + 1):
            like = m * np.log(p) + (n - m) * np.log1p(-p)
            like = np.exp(like - like.max())
            if like[j >= threshold].sum() >= tolerance * like.sum():
                out.append(m)
                break
    return out


def text_classes(texts: DataFrame, id_col: str, k: int) -> tuple[DataFrame, DataFrame]:
    """(members: id, cls) and (classes: cls, text), both written to the shared folder; texts of fewer than ``k`` words are in neither.

    ``text`` is the words between single blanks. Classes are numbered when they are written, so two texts never share a number.
    """
    toks = texts.select(F.col(id_col).alias("id"), words(F.coalesce(F.col("text"), F.lit(""))).alias("w")).where(F.size("w") >= k)
    toks = toks.select("id", F.array_join("w", " ").alias("text"))
    toks = materialize(toks.select("id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("text_key"), "text"), "texts")
    rep = toks.groupBy("text_key").agg(F.min("text").alias("text")).select("text_key", F.monotonically_increasing_id().alias("cls"), "text")
    classes = materialize(rep, "classes")
    members = materialize(toks.select("id", "text_key").join(classes.select("text_key", "cls"), "text_key").select("id", "cls"), "members")
    return members, classes.select("cls", "text")


def near_duplicates(
    texts: DataFrame, id_col: str = "id", k: int = 5, threshold: float = 0.8, bands: int = 40, rows: int = 8, tolerance: float = 1e-4, seed: int = 7
) -> tuple[DataFrame, DataFrame]:
    """(members: ``id, cls``; links: ``cls_a < cls_b, similarity``) of texts whose shingle sets' Jaccard similarity is at least ``threshold``.

    ``texts`` has ``id_col`` (unique) and ``text``; other columns are ignored. Members are the records of each class (same
    words in the same order); links join classes of different texts. Null, empty and too short texts have no shingles and are in
    neither result. Equal similarity at the threshold counts. Very long texts cost in proportion to their length. No
    bucket and no list of partners is capped. A pair just at the threshold is missed as a candidate with probability
    ``(1 - threshold**rows)**bands``; a pair is pruned wrongly with probability below ``tolerance`` per step.
    """
    members, classes = text_classes(texts, id_col, k)
    n = bands * rows
    steps = [min(64 * (i + 1), n) for i in range(-(-n // 64))]
    least = least_matches(threshold, tolerance, steps)
    signed = materialize(classes.mapInPandas(_signed(k, bands, rows, seed), "cls bigint, keys array<bigint>, sketch array<bigint>"), "signatures")
    keyed = signed.select("cls", F.col("sketch")[0].alias("s"), F.explode("keys").alias("key"))
    a, b = keyed.alias("a"), keyed.alias("b")
    first = steps[0] - F.bit_count(F.col("a.s").bitwiseXOR(F.col("b.s"))) >= least[0]
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.cls") < F.col("b.cls")) & first).select(F.col("a.cls").alias("cls_a"), F.col("b.cls").alias("cls_b")).distinct()
    if len(steps) > 1:
        sketch = signed.select("cls", "sketch")
        pairs = pairs.join(sketch.select(F.col("cls").alias("cls_a"), F.col("sketch").alias("sa")), "cls_a").join(sketch.select(F.col("cls").alias("cls_b"), F.col("sketch").alias("sb")), "cls_b")
        differing, keep = F.lit(0), F.lit(True)
        for i, (step, m) in enumerate(zip(steps, least)):
            # conjuncts are evaluated in order, so a pair dropped early costs no further word; unused bits never differ
            differing = differing + F.bit_count(F.col("sa")[i].bitwiseXOR(F.col("sb")[i]))
            keep = keep & (F.lit(step) - differing >= m)
        pairs = pairs.where(keep).select("cls_a", "cls_b")
    kept = materialize(pairs, "candidates")
    wanted = kept.select(F.col("cls_a").alias("cls")).unionByName(kept.select(F.col("cls_b").alias("cls"))).distinct()
    sets = materialize(classes.join(wanted, "cls").mapInPandas(_shingle_sets(k), "cls bigint, shingles array<bigint>"), "shingles")
    kept = kept.join(sets.select(F.col("cls").alias("cls_a"), F.col("shingles").alias("x")), "cls_a").join(sets.select(F.col("cls").alias("cls_b"), F.col("shingles").alias("y")), "cls_b")
    both = F.size(F.array_intersect("x", "y"))
    exact = kept.select("cls_a", "cls_b", (both / (F.size("x") + F.size("y") - both)).alias("similarity"))
    return members, exact.where(F.col("similarity") >= threshold)


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``cls, root``: for every class in ``links`` (cls_a, cls_b) the least class of its connected component.

    Large-star and small-star in turn: every class is tied to the least of its neighbours, first those above it, then those below, until nothing changes.
    The edges stay distributed and are written each round; a class with very many neighbours is one key of a partial aggregate and of a join, whose
    skewed partitions are split. The number of rounds grows with the logarithm of the longest chain; more than ``rounds`` are an error.
    """
    edges = materialize(links.select(F.greatest("cls_a", "cls_b").alias("u"), F.least("cls_a", "cls_b").alias("v")).where("u > v").distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "edges-large")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).distinct()
        edges = materialize(small, "edges-small")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    return edges.select(F.col("u").alias("cls"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("cls"), F.col("v").alias("root")).distinct())


def groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """``id, group``: records that are copies of each other or linked, directly or through others; ``group`` is the least id (as a string) in it.

    Records alike to no other are in no group. One row per record; pairs are never expanded.
    """
    own = members.select(F.col("id").cast("string").alias("id"), "cls")
    roots = components(links)
    rooted = own.join(roots, "cls", "left").select("id", F.coalesce("root", "cls").alias("root"))
    rooted = materialize(rooted, "rooted")
    named = rooted.groupBy("root").agg(F.min("id").alias("group"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rooted.join(named, "root").select("id", "group")


def expand_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """All pairs of records, ``id_a < id_b`` as strings, within classes and across linked classes."""
    a, b = members.select(F.col("id").cast("string").alias("id_a"), F.col("cls").alias("cls_a")), members.select(F.col("id").cast("string").alias("id_b"), F.col("cls").alias("cls_b"))
    same = a.join(b, (F.col("cls_a") == F.col("cls_b")) & (F.col("id_a") < F.col("id_b"))).select("id_a", "id_b")
    across = links.select("cls_a", "cls_b").join(a, "cls_a").join(b, "cls_b").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    return same.unionByName(across)
