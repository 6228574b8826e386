"""Filling containers of fixed capacity with documents, sizes in tokens of a public tokenizer.

Bounded-space online best fit: each task keeps a fixed number of open containers in a bitset keyed by free space (bit f is set
where a container with f free tokens is open). An item goes to the fullest open container it fits in, which is the lowest set bit at or
above its size; if none fits, a new one opens, and where that would be one too many the fullest is closed first. Items
larger than the capacity are split into full containers and a rest, which is placed like an item. Tasks pack alone; what each leaves
open is at most the bound, and those rests are packed once more together.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import materialize

_LOADED: dict[str, object] = {}


def default_tokenizer() -> str:
    """The byte-level BPE file of the installed tokenizer package; its folder may be set by LECTERN_TOKENIZERS."""
    return os.path.join(os.environ.get("LECTERN_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.json")


def _tokenizer(path: str):
    if path not in _LOADED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        _LOADED[path] = t
    return _LOADED[path]


#: White space with the word after it. A byte-level pre-tokenizer always cuts where white space begins, so a text's tokens are those of its pieces.
PIECE = re.compile(r"\s+\S*|\S+")
#: Characters that are white space to one of the two pattern languages only: texts with them are not taken apart.
UNSURE = re.compile("[\x1c-\x1f\x85\u180e\ufeff]")


class PieceCounts(dict):
    """Number of tokens of each piece met so far; forgotten beyond ``most`` pieces, so it never grows with the data."""

    def __init__(self, tokenizer, most: int = 1_000_000):
        self.encode, self.most = tokenizer.encode, most

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self.encode(piece, add_special_tokens=False).ids)
        return n

    def of(self, text: str) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        if UNSURE.search(text):
            return len(self.encode(text, add_special_tokens=False).ids)
        if len(self) > self.most:
            self.clear()
        if len(text) > 1_000_000:
            return sum(self[m[0]] for m in PIECE.finditer(text))
        return sum(map(self.__getitem__, PIECE.findall(text)))


def _by_bytes(tokenizer) -> bool:
    """Whether a tokenizer cuts at white space first, neither changing the text nor adding a space before it."""
    import json

    known = json.loads(tokenizer.to_str())
    pre = known.get("pre_tokenizer") or {}
    return known.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")


def token_counts(df: DataFrame, path: str, text: str = "text", out: str = "tokens") -> DataFrame:
    """The columns of ``df`` without ``text``, and the number of tokens of the whole text (null and empty: 0).

    With a byte-level tokenizer each distinct piece (white space and the word after it) is encoded once per task and the counts are summed, which
    gives the same number as encoding the text; other tokenizers encode whole texts. A map over batches, not an expression, so no plan evaluates it twice.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = _tokenizer(path)
        pieces = PieceCounts(t) if _by_bytes(t) else None
        for pdf in batches:
            codes, distinct = pd.factorize(pdf[text].fillna(""))
            if pieces is not None:
                sizes = np.array([pieces.of(x) for x in distinct], np.int64)
            else:
                sizes = np.zeros(len(distinct), np.int64)
                for low in range(0, len(distinct), 256):
                    sizes[low : low + 256] = [len(e.ids) for e in t.encode_batch_fast(list(distinct[low : low + 256]), add_special_tokens=False)]
            yield pdf.drop(columns=[text]).assign(**{out: sizes[codes]})

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in (text, out)]
    return df.select(*[f.name for f in df.schema if f.name != out]).mapInPandas(count, ", ".join([*kept, f"`{out}` bigint"]))


class OpenBins:
    """At most ``most`` open containers of one capacity, found by free space through a bitset."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.free, self.bits, self.count = capacity, most, {}, 0, 0

    def place(self, size: int) -> tuple[int | None, int | None]:
        """(container used or None for a new one, container closed for it or None)."""
        above = self.bits >> size
        if above:
            f = size + (above & -above).bit_length() - 1
            bins = self.free[f]
            b = bins.pop()
            self.count -= 1
            if not bins:
                self.bits &= ~(1 << f)
            return b, None
        closed = None
        if self.count >= self.most:
            f = (self.bits & -self.bits).bit_length() - 1
            closed = self.free[f].pop()
            self.count -= 1
            if not self.free[f]:
                self.bits &= ~(1 << f)
        return None, closed

    def hold(self, b: int, free: int) -> None:
        """Keep container b open with that much free; full ones are not kept."""
        if free > 0:
            self.free.setdefault(free, []).append(b)
            self.bits |= 1 << free
            self.count += 1


def _pack(capacities: dict[str, int], most: int, stage: str):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        state = {w: [OpenBins(c, most), 0, {}] for w, c in capacities.items()}
        for pdf in batches:
            rows = []
            for item, part, size, window in zip(pdf["item"], pdf["part"], pdf["size"], pdf["window"]):
                size = int(size)
                for w in capacities if window is None or window != window else [window]:
                    bins, made, left = state[w]
                    b, closed = bins.place(size)
                    if closed is not None:
                        left.pop(closed)
                    if b is None:
                        b = made
                        state[w][1] = made = made + 1
                        left[b] = capacities[w]
                    left[b] -= size
                    free = left[b]
                    if free > 0:
                        bins.hold(b, free)
                    else:
                        left.pop(b)
                    rows.append((w, f"{stage}{task}-{b}", item, int(part), size))
            yield pd.DataFrame(rows, columns=["window", "container", "item", "part", "size"])
        # what is still open at the end of the task
        rows = [(w, f"{stage}{task}-{b}", None, -1, capacities[w] - f) for w, (_, _, left) in state.items() for b, f in left.items()]
        yield pd.DataFrame(rows, columns=["window", "container", "item", "part", "size"])

    return pack


def pack_documents(items: DataFrame, capacities: dict[str, int], open_bins: int = 64, tokens_per_task: int = 4_000_000) -> DataFrame:
    """``window, container, item, part, size`` for items ``item, size`` (item ids as strings): containers of each window's capacity.

    An item of at most the capacity is one part 0; a larger one is split into parts of full capacity, each a container of its own,
    and a rest. Items of size 0 or null take no place and are left out; a null item keeps its null id; items with equal
    ids are placed separately. Sizes within a container never exceed the capacity. Nothing but the ``open_bins`` containers a
    task leaves open per window can be badly filled, and those are packed once more among all tasks, at least ``tokens_per_task`` tokens in each
    task of the second pass (so a small rest is one task's work).
    """
    schema = "window string, container string, item string, part int, size long"
    sized = items.where(F.col("size") > 0).select(F.col("item").cast("string").alias("item"), F.col("size").cast("long").alias("size"))
    windows = F.explode(F.array(*[F.struct(F.lit(w).alias("window"), F.lit(c).alias("cap")) for w, c in capacities.items()])).alias("w")
    parts = sized.select("item", "size", windows).select("item", "size", "w.window", "w.cap")
    n = F.floor((F.col("size") - 1) / F.col("cap")).cast("int")
    parts = parts.select("window", "item", "size", "cap", F.explode(F.sequence(F.lit(0), n)).alias("part"))
    parts = parts.select("window", "item", "part", F.least(F.col("size") - F.col("part") * F.col("cap"), F.col("cap").cast("long")).alias("size"))
    packed = materialize(parts.mapInPandas(_pack(capacities, open_bins, "a"), schema), "packed")
    # open containers are items themselves; there are at most open_bins of them per task and window
    again = packed.where("part = -1").select("window", F.xxhash64("window", "container").cast("string").alias("item"), F.col("part"), "size")
    rest = packed.where("part = -1").groupBy("window").agg(F.sum("size").alias("s")).agg(F.max("s")).first()[0] or 0
    again = again.repartition(max(1, int(rest // tokens_per_task)), F.xxhash64("item")).mapInPandas(_pack(capacities, open_bins, "b"), schema)
    # written before use: a task that runs again may place its rows in another order
    again = materialize(again, "packed-again")
    merged = again.where("part = -1 and item is not null").select("window", F.col("item").alias("key"), F.col("container").alias("into"))
    return packed.where("part >= 0").withColumn("key", F.xxhash64("window", "container").cast("string")).join(merged, ["window", "key"], "left").select("window", F.coalesce("into", "container").alias("container"), "item", "part", "size")


def fill_report(packed: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """``window, capacity, containers, items, tokens, unused, fill``: how much of the containers is used."""
    cap = F.lit(0).cast("long")
    for w, c in capacities.items():
        cap = F.when(F.col("window") == w, F.lit(c).cast("long")).otherwise(cap)
    by = packed.groupBy("window", "container").agg(F.count("*").alias("items"), F.sum("size").alias("tokens"))
    out = by.groupBy("window").agg(F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
    out = out.withColumn("capacity", cap)
    return out.select("window", "capacity", "containers", "items", "tokens", "fullest", (F.col("containers") * F.col("capacity") - F.col("tokens")).alias("unused"), F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("fill"))
