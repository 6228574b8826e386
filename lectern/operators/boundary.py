"""External models behind replaceable boundaries: any function from texts to vectors or JSON, with deterministic local stand-ins.

A boundary is called once per Arrow batch, in ``rows``-sized requests, and retried with growing pauses; a request that keeps failing gives
nulls and an error text for its rows, never a failed job.
"""

from __future__ import annotations

import re
import time
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hashed_embedding(texts: list[str], dim: int = 64) -> list[list[float]]:
    """Stand-in for a text embedding: signed hashed words, unit length; zero for a text without words."""
    out = []
    for t in texts:
        t = (t or "").lower()
        # the same words either way, but of ASCII texts faster
        h = np.fromiter(map(_word_hash, t.translate(_BLANKS).split() if t.isascii() else re.findall(r"[^\W_]+", t)), np.int64)
        v = np.bincount(h % dim, weights=np.where(h & 0x10000, 1.0, -1.0), minlength=dim)
        n = np.linalg.norm(v)
        out.append((v / n if n else v).tolist())
    return out


_BLANKS = {i: " " for i in range(128) if not chr(i).isalnum()}


@lru_cache(1 << 16)
def _word_hash(word: str) -> int:
    return zlib.crc32(word.encode())


def call_model(df: DataFrame, column: str, model: Callable[[list[str]], list], kind: str, out: str, rows: int = 100, tries: int = 4, pause: float = 1.0) -> DataFrame:
    """Adds ``out`` (of SQL type ``kind``) and ``<out>_error`` from ``model`` over the texts of ``column``; null texts are sent as ''."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, got, errors = pdf[column].fillna("").tolist(), [], []
            for low in range(0, len(texts), rows):
                part = texts[low : low + rows]
                for attempt in range(tries):
                    try:
                        answer, error = model(part), None
                        if len(answer) != len(part):
                            raise ValueError(f"{len(answer)} answers to {len(part)} texts")
                        break
                    except Exception as e:  # noqa: BLE001
                        answer, error = [None] * len(part), f"{type(e).__name__}: {e}"[:300]
                        if attempt + 1 < tries:
                            time.sleep(pause * 2**attempt)
                got += answer
                errors += [error] * len(part)
            yield pdf.assign(**{out: got, f"{out}_error": errors})

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema]
    return df.mapInPandas(run, ", ".join([*kept, f"`{out}` {kind}", f"`{out}_error` string"]))


def json_answer(column: str, schema: str):
    """A struct from a model's text answer: fences are stripped, else the outermost braces are taken; null where neither parses."""
    t = F.regexp_replace(F.col(column), r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", "")
    inner = F.regexp_extract(F.col(column), r"(?s)(\{.*\})", 1)
    first, second = F.from_json(t, schema), F.from_json(inner, schema)
    filled = lambda s: F.to_json(s) != "{}"
    return F.when(filled(first), first).when(filled(second), second)
