"""Self-organising maps: batch training with one aggregation per epoch; the small grid is all that is broadcast."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..shipping import ship


@dataclass
class Grid:
    width: int
    height: int
    hexagonal: bool = False
    toroidal: bool = False

    def places(self) -> np.ndarray:
        x, y = np.meshgrid(np.arange(self.width, dtype=float), np.arange(self.height, dtype=float))
        if self.hexagonal:
            x = x + 0.5 * (y.astype(int) % 2)
            y = y * math.sqrt(3) / 2
        return np.stack([x.ravel(), y.ravel()], 1)

    def distances(self) -> np.ndarray:
        p = self.places()
        d = np.abs(p[:, None] - p[None])
        if self.toroidal:
            size = np.array([self.width, self.height * (math.sqrt(3) / 2 if self.hexagonal else 1)])
            d = np.minimum(d, size - d)
        return np.sqrt((d**2).sum(2))

    def neighbours(self) -> list[tuple[int, int]]:
        d = self.distances()
        return [(int(a), int(b)) for a, b in zip(*np.nonzero((d > 0) & (d < 1.01)))]


def kernel(distance: np.ndarray, radius: float, kind: str = "gaussian") -> np.ndarray:
    if kind == "bubble":
        return (distance <= radius).astype(float)
    if kind == "linear":
        return np.maximum(0, 1 - distance / max(radius, 1e-9))
    s2 = (max(radius, 1e-9) / 3) ** 2 * 2
    g = np.exp(-(distance**2) / s2)
    return (1 - 2 * distance**2 / s2) * g if kind == "mexican_hat" else g


def schedule(t: float, first: float, last: float, kind: str = "exponential") -> float:
    """A value that goes from first to last as t goes from 0 to 1."""
    if kind == "linear":
        return first + (last - first) * t
    if kind == "inverse":
        return last + (first - last) / (1 + 9 * t)
    if kind == "step":
        return first * (last / first) ** (math.floor(t * 4) / 4)
    return first * (last / first) ** t


def start(grid: Grid, dims: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).normal(0, 0.1, (grid.width * grid.height, dims))


def train(vectors: DataFrame, grid: Grid, *, epochs: int = 10, final_radius: float = 0.5, rate: float = 1.0, vector_col: str = "v", tolerance: float = 1e-4) -> tuple[np.ndarray, list[float]]:
    """Weights (a row per cell) and the mean quantisation error of each epoch. Nulls are left out."""
    spark = vectors.sparkSession
    ship(spark)
    dims = len(vectors.where(f"{vector_col} is not null").select(vector_col).first()[0])
    data = vectors.where(f"{vector_col} is not null and size({vector_col}) = {dims}").select(vector_col)
    weights, distance, errors = start(grid, dims), grid.distances(), []
    cells = len(weights)
    for epoch in range(epochs):
        radius = schedule(epoch / max(epochs - 1, 1), max(grid.width, grid.height) / 2, final_radius)
        shared = spark.sparkContext.broadcast(weights)

        def partial(frames, shared=shared):
            w, sums, counts, error = shared.value, np.zeros((cells, dims)), np.zeros(cells), 0.0
            for frame in frames:
                x = np.stack(frame.iloc[:, 0].to_numpy()).astype(float)
                d = (x**2).sum(1)[:, None] - 2 * x @ w.T + (w**2).sum(1)
                best = d.argmin(1)
                np.add.at(sums, best, x)
                counts += np.bincount(best, minlength=cells)
                error += np.sqrt(np.maximum(d[np.arange(len(x)), best], 0)).sum()
            yield pd.DataFrame({"cell": np.arange(cells), "n": counts, "sum": list(sums), "error": np.r_[error, np.zeros(cells - 1)]})

        rows = data.mapInPandas(partial, "cell int, n double, sum array<double>, error double").groupBy("cell").applyInPandas(
            lambda f: pd.DataFrame({"cell": [f.cell.iloc[0]], "n": [f.n.sum()], "sum": [np.sum(np.stack(f["sum"].to_numpy()), 0)], "error": [f.error.sum()]}), "cell int, n double, sum array<double>, error double"
        ).collect()
        sums, counts = np.zeros((cells, dims)), np.zeros(cells)
        for r in rows:
            sums[r.cell], counts[r.cell] = r["sum"], r.n
        h = kernel(distance, radius)
        mass = h @ counts
        weights = np.where(mass[:, None] > 1e-9, (1 - rate) * weights + rate * (h @ sums) / np.maximum(mass, 1e-9)[:, None], weights)
        errors.append(sum(r.error for r in rows) / max(counts.sum(), 1))
        if len(errors) >= 10 and np.std(errors[-10:]) < tolerance:
            break
    return weights, errors


def assign(vectors: DataFrame, weights: np.ndarray, *, id_col: str = "vec_id", vector_col: str = "v") -> DataFrame:
    """id, best cell, distance to it, second-best cell."""
    ship(vectors.sparkSession)
    shared = vectors.sparkSession.sparkContext.broadcast(weights)

    def near(frames):
        w = shared.value
        for frame in frames:
            x = np.stack(frame.iloc[:, 1].to_numpy()).astype(float)
            d = np.sqrt(np.maximum((x**2).sum(1)[:, None] - 2 * x @ w.T + (w**2).sum(1), 0))
            two = np.argsort(d, 1, kind="stable")[:, :2]
            yield pd.DataFrame({"id": frame.iloc[:, 0], "cell": two[:, 0].astype("int32"), "distance": d[np.arange(len(x)), two[:, 0]], "second": two[:, -1].astype("int32")})

    return vectors.where(f"size({vector_col}) = {weights.shape[1]}").select(id_col, vector_col).mapInPandas(near, "id long, cell int, distance double, second int")


def quality(assigned: DataFrame, grid: Grid) -> DataFrame:
    """One row: mean distance to the best cell, and the share of vectors whose two best cells are not neighbours."""
    from pyspark.sql import functions as F

    d = grid.distances()
    far = assigned.sparkSession.createDataFrame([(int(a), int(b)) for a, b in zip(*np.nonzero(d > math.sqrt(2) + 1e-9))] or [(-1, -1)], "cell int, second int")
    joined = assigned.join(F.broadcast(far.withColumn("far", F.lit(1))), ["cell", "second"], "left")
    return joined.agg(F.avg("distance").alias("quantisation_error"), F.avg(F.coalesce("far", F.lit(0)).cast("double")).alias("topographic_error"))


def clusters(weights: np.ndarray, grid: Grid, *, similarity: float = 0.8, least: int = 3) -> list[list[int]]:
    """Groups of neighbouring cells with cosine over ``similarity``, of ``least`` cells or more."""
    unit = weights / np.maximum(np.linalg.norm(weights, axis=1, keepdims=True), 1e-12)
    group = list(range(len(weights)))

    def root(i: int) -> int:
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    for a, b in grid.neighbours():
        if unit[a] @ unit[b] > similarity:
            group[max(root(a), root(b))] = min(root(a), root(b))
    found: dict[int, list[int]] = {}
    for i in range(len(weights)):
        found.setdefault(root(i), []).append(i)
    return sorted((g for g in found.values() if len(g) >= least), key=len, reverse=True)


def u_matrix(weights: np.ndarray, grid: Grid) -> np.ndarray:
    """Mean distance of each cell's weights to its neighbours'."""
    total, n = np.zeros(len(weights)), np.zeros(len(weights))
    for a, b in grid.neighbours():
        total[a] += np.linalg.norm(weights[a] - weights[b])
        n[a] += 1
    return total / np.maximum(n, 1)
