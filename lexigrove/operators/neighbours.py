"""Neighbour embedding: UMAP (McInnes, Healy and Melville, 2018).

The fuzzy graph of the k nearest neighbours is found and symmetrised by DataFrames
(exact search by blocks, see knn).  The layout moves all points a little in every
epoch, so it runs on the driver, vectorised, from the graph's edges: at most
``max_points`` points, an error beyond.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import knn, learn


def smooth(distances: np.ndarray, rounds: int = 64) -> np.ndarray:
    """Memberships of each row's neighbours: they sum to log2 of their number, the nearest has 1.

    ``distances``: rows x neighbours, nearest first, NaN where there are fewer.
    """
    there = ~np.isnan(distances)
    rho = np.nanmin(np.where(distances > 0, distances, np.nan), axis=1, initial=np.inf)
    away = np.maximum(0, np.where(there, distances, 0) - np.where(np.isfinite(rho), rho, 0)[:, None])
    target = np.log2(there.sum(axis=1))
    low, high, width = np.zeros(len(away)), np.full(len(away), np.inf), np.ones(len(away))
    for _ in range(rounds):
        total = np.where(there, np.exp(-away / width[:, None]), 0).sum(axis=1)
        wide = total > target
        high, low = np.where(wide, width, high), np.where(wide, low, width)
        width = np.where(np.isinf(high), width * 2, (low + np.where(np.isinf(high), 0, high)) / 2)
    # A width far below the distances says nothing but that neighbours are equally far.
    mean = np.where(there, distances, 0).sum(axis=1) / np.maximum(1, there.sum(axis=1))
    return np.where(there, np.exp(-away / np.maximum(width, 1e-3 * mean + 1e-12)[:, None]), 0)


def fuzzy_graph(points: DataFrame, n_neighbors: int = 15, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(a, b, weight), a < b: w + v - w v of the memberships in both directions."""
    near = knn.nearest(points, points, n_neighbors - 1, True, id_col, vec_col, euclidean=True)
    rows = near.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "neighbor_id"))).alias("n"))  # n_neighbors at most
    rows = rows.select("query_id", F.col("n.neighbor_id").alias("ids"), F.col("n.score").alias("distances"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            size = b.column(2).value_lengths().to_numpy()
            d = np.full((b.num_rows, size.max()), np.nan)
            at = np.arange(d.shape[1])[None, :] < size[:, None]
            d[at] = b.column(2).flatten().to_numpy()
            who = np.repeat(b.column(0).to_numpy(), size)
            yield pa.RecordBatch.from_arrays([pa.array(who), b.column(1).flatten(), pa.array(smooth(d)[at])], names=["p", "q", "w"])

    one_way = rows.mapInArrow(run, "p long, q long, w double")
    pairs = one_way.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "w").groupBy("a", "b")
    both = pairs.agg(F.sum("w").alias("s"), F.min("w").alias("x"), F.max("w").alias("y"), F.count("*").alias("n"))
    return both.select("a", "b", F.when(F.col("n") > 1, F.col("s") - F.col("x") * F.col("y")).otherwise(F.col("s")).alias("weight"))


def curve(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """a and b for which 1 / (1 + a x^2b) comes nearest to 1 up to min_dist and then exp(-(x - min_dist) / spread)."""
    x = np.linspace(0, 3 * spread, 300)[1:]
    want = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    a, b, step = 1.0, 1.0, 0.5
    error = lambda a, b: ((1 / (1 + a * x ** (2 * b)) - want) ** 2).sum()
    while step > 1e-4:
        around = [(a * math.exp(i * step), b * math.exp(j * step)) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        best = min(around, key=lambda p: error(*p))
        if error(*best) < error(a, b) - 1e-15:
            a, b = best
        else:
            step /= 2
    return a, b


#: Moves of the layout that are computed at a time.
MOVES = 4096


def layout(start: np.ndarray, edges: np.ndarray, weights: np.ndarray, min_dist: float, epochs: int, negatives: int = 5, seed: int = 42) -> np.ndarray:
    """Places after gradient steps: edges pull in proportion to their weight, random points push."""
    rng = np.random.default_rng(seed)
    a, b = curve(min_dist)
    y = start.copy()
    share = weights / weights.max() if len(weights) else weights
    for epoch in range(epochs):
        rate = 1.0 - epoch / epochs
        # An edge acts in so many epochs as its weight says, evenly spread.
        now = np.floor((epoch + 1) * share) > np.floor(epoch * share)
        i, j = edges[now].T if now.any() else np.zeros((2, 0), int)
        k = np.repeat(np.concatenate([i, j]), negatives)
        far = rng.integers(0, len(y), len(k))
        who, n = np.concatenate([i, j, k]), len(i)
        moves = np.empty((y.shape[1], len(who)))
        # A few thousand moves at a time, which stay in the cache.
        for lo in range(0, n, MOVES):
            at = slice(lo, min(lo + MOVES, n))
            d = y[i[at]] - y[j[at]]
            r = (d * d).sum(axis=1)
            pull = np.where(r > 0, -2 * a * b * np.maximum(r, 1e-12) ** (b - 1) / (1 + a * r**b), 0)
            moves[:, at] = (np.clip(pull[:, None] * d, -4, 4) * rate).T
        moves[:, n : 2 * n] = -moves[:, :n]
        for lo in range(0, len(k), MOVES):
            at = slice(lo, min(lo + MOVES, len(k)))
            d = y[k[at]] - y[far[at]]
            r = (d * d).sum(axis=1)
            push = np.where((r > 0) & (k[at] != far[at]), 2 * b / ((0.001 + r) * (1 + a * r**b)), 0)
            moves[:, 2 * n + at.start : 2 * n + at.stop] = (np.clip(push[:, None] * d, -4, 4) * rate).T
        # Sums in the order of the moves, a dimension at a time.
        change = np.stack([np.bincount(who, m, minlength=len(y)) for m in moves], axis=1)
        # Many moves of one point in one epoch must not throw it across the plane.
        length = np.linalg.norm(change, axis=1, keepdims=True)
        y += change * np.minimum(1.0, 4.0 * rate / np.maximum(length, 1e-12))
    return y


def umap(points: DataFrame, n_components: int = 2, n_neighbors: int = 15, min_dist: float = 0.0, epochs: int | None = None, seed: int = 42, max_points: int = 200_000, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, projected (array of n_components): PCA scores moved by the fuzzy graph.  Null vectors are left out."""
    rows = points.where(F.col(vec_col).isNotNull())
    n = rows.count()
    if n > max_points:
        raise ValueError(f"{n} points; at most {max_points} can be laid out")
    spark = points.sparkSession
    out = f"{id_col} {dict(points.dtypes)[id_col]}, projected array<double>"
    if n < 3:
        return rows.select(id_col, F.array(*(F.lit(0.0) for _ in range(n_components))).alias("projected"))
    width = rows.select(F.size(vec_col)).first()[0]
    scores, _ = learn.pca(learn.to_vectors(rows, vec_col), min(n_components, width))
    first = scores.select(F.col(id_col).cast("long").alias("id"), "projected").toArrow().sort_by("id")
    ids = first.column("id").to_numpy()
    place = np.array(first.column("projected").to_pylist(), "f8").reshape(len(ids), -1)
    place = np.pad(place, ((0, 0), (0, n_components - place.shape[1])))
    rng = np.random.default_rng(seed)
    place = 10 * place / max(np.abs(place).max(), 1e-12) + rng.normal(scale=1e-4, size=place.shape)
    graph = fuzzy_graph(rows, min(n_neighbors, n), id_col, vec_col).toArrow().sort_by([("a", "ascending"), ("b", "ascending")])
    edges = np.stack([np.searchsorted(ids, graph.column(c).to_numpy()) for c in ("a", "b")], axis=1)
    done = layout(place, edges, graph.column("weight").to_numpy(), min_dist, epochs or (500 if n <= 10_000 else 200), seed=seed)
    return spark.createDataFrame(pa.table({id_col: ids, "projected": pa.array(list(done), pa.list_(pa.float64()))}), out.replace(f"{id_col} bigint", f"{id_col} long"))
