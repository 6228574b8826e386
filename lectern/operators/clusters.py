"""Order-dependent grouping within a record: greedy clusters by centroid, and lists freed of near repeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.boundary import hashed_embedding


class Centroids:
    """Sums of the members of the clusters begun so far; an item is held against the newest ``look_back`` of them at once."""

    def __init__(self, width: int, look_back: int, threshold: float):
        self.sums, self.look_back, self.threshold = np.zeros((8, width)), look_back, threshold
        self.n = 0

    def assign(self, unit: np.ndarray, item: np.ndarray) -> int:
        """The cluster an item joins: the most alike of the newest by cosine with their means (the first of equals) if at the threshold, otherwise a new one."""
        low = max(0, self.n - self.look_back)
        means = self.sums[low : self.n]
        if len(means):
            likeness = means @ unit / np.maximum(np.sqrt(np.einsum("ij,ij->i", means, means)), 1e-9)
            best = int(likeness.argmax())
            if likeness[best] >= self.threshold:
                self.sums[low + best] += item
                return low + best
        if self.n == len(self.sums):
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
        self.sums[self.n] = item
        self.n += 1
        return self.n - 1


def sequential_clusters(vectors: np.ndarray, threshold: float, look_back: int) -> list[int]:
    """Cluster numbers of vectors in order. The cosine with a mean is that with the sum, so only sums are kept."""
    units = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    held = Centroids(vectors.shape[1], look_back, threshold)
    return [held.assign(u, v) for u, v in zip(units, vectors)]


def centroid_clusters(df: DataFrame, id_col: str, items: str, threshold: float = 0.45, look_back: int = 5, embed=hashed_embedding) -> DataFrame:
    """``id, position, cluster``: each item (array<string>, in order) joins the most alike of the last clusters, or begins one.

    Null and empty arrays give nothing. The list of a record is one row, so records are spread over tasks whatever their number.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, texts in zip(pdf["id"], pdf["items"]):
                if texts is not None and len(texts):
                    rows += [(i, n, c) for n, c in enumerate(sequential_clusters(np.array(embed(list(texts)), float), threshold, look_back))]
            yield pd.DataFrame(rows, columns=["id", "position", "cluster"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(items).alias("items")).mapInPandas(run, f"id {kind}, position int, cluster int")


def keep_distinct(items, tokens_of, most_alike: float = 0.72):
    """Of an array of strings, in order, those whose token sets have a Jaccard similarity below ``most_alike`` to all kept before."""
    from lectern.functions.text import jaccard

    def step(kept, x):
        near = F.exists(kept, lambda k: jaccard(tokens_of(k), tokens_of(x)) >= most_alike)
        return F.when(near, kept).otherwise(F.concat(kept, F.array(x)))

    return F.aggregate(items, F.array().cast("array<string>"), step)
