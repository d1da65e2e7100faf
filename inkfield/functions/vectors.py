"""Similarity of embeddings: cosine natively; optimal transport and kernel distance in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Members of a random subset and number of subsets of the kernel distance.
SUBSET, SUBSETS = 50, 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null for a null or zero vector."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


def dream_similarity(distance: Column) -> Column:
    return 1 - distance


def assignment(cost: np.ndarray) -> float:
    """Least total cost of matching rows to columns of a square matrix (augmenting paths with potentials)."""
    n = len(cost)
    u, v, match = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        match[0], j = i, 0
        low, way, used = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.zeros(n + 1, bool)
        while match[j]:
            used[j] = True
            r = match[j]
            free = ~used[1:]
            reduced = cost[r - 1] - u[r] - v[1:]
            better = free & (reduced < low[1:])
            low[1:][better], way[1:][better] = reduced[better], j
            nxt = 1 + int(np.argmin(np.where(free, low[1:], np.inf)))
            step = low[nxt]
            u[match[used]] += step
            v[used] -= step
            low[1:][free] -= step
            j = nxt
        while j:
            match[j], j = match[way[j]], way[j]
    return float(sum(cost[match[j] - 1, j - 1] for j in range(1, n + 1)))


def transport_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """2 tanh(-EMD) + 1 of two patch sets (rows), cosine distance, uniform weights: an assignment after repeating both sets
    to a common number of rows."""
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    n = int(np.lcm(len(a), len(b)))
    cost = 1 - unit(np.repeat(a, n // len(a), 0)) @ unit(np.repeat(b, n // len(b), 0)).T
    return float(2 * np.tanh(-assignment(cost) / n) + 1)


def transport_column(a: Column, b: Column, patches: int) -> Column:
    """Vectors cut into `patches` equal parts, compared as sets of patches. Null if a side is."""
    def batches(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in pairs:
            yield pd.Series([None if p is None or q is None else transport_similarity(np.asarray(p, float).reshape(patches, -1), np.asarray(q, float).reshape(patches, -1)) for p, q in zip(x, y, strict=True)], dtype="float64")

    return F.pandas_udf(batches, "double")(a, b)


def mmd(x: np.ndarray, y: np.ndarray) -> float:
    """Unbiased squared discrepancy under the kernel (x.y/d + 1)^3."""
    k = lambda p, q: (p @ q.T / p.shape[1] + 1) ** 3
    n, m = len(x), len(y)
    xx, yy, xy = k(x, x), k(y, y), k(x, y)
    return float((xx.sum() - np.trace(xx)) / (n * (n - 1)) + (yy.sum() - np.trace(yy)) / (m * (m - 1)) - 2 * xy.mean())


def kernel_distance(rows: DataFrame, key: str, side: str, vector: str, subset: int = SUBSET, subsets: int = SUBSETS, seed: int = 0) -> DataFrame:
    """(mean, std) of the discrepancy between the rows of side 0 and 1 over seeded random subsets.

    Each subset takes the `subset` rows of either side that come first in its own hash order, all found in one pass over the
    rows, of which each task passes on no more than that; these, subsets * 2 * subset in all, meet in a task per subset.
    """
    each = rows.filter(F.col(side).isin(0, 1)).select(F.col(key).alias("k"), F.col(side).alias("side"), F.col(vector).alias("v"), F.explode(F.sequence(F.lit(0), F.lit(subsets - 1))).alias("s"))
    first = Window.partitionBy("s", "side").orderBy(F.xxhash64("k", F.lit(seed * 1000) + F.col("s")), "k")
    tops = each.withColumn("_i", F.row_number().over(first)).filter(F.col("_i") <= subset).select("s", "side", "v")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = (np.array([np.asarray(v, float) for v in pdf.loc[pdf["side"] == w, "v"]]) for w in (0, 1))
        return pd.DataFrame({"d": [mmd(x, y) if len(x) > 1 and len(y) > 1 else np.nan]})

    each = tops.groupBy("s").applyInPandas(one, "d double").filter("not isnan(d)")
    return each.agg(F.avg("d").alias("mean"), F.stddev_samp("d").alias("std"))
