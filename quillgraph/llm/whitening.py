"""Embedding whitening by a randomised range finder.

Entries become whole numbers x = floor(scale * c) + offset, so that counts, sums and deviations are exact. The fit list is
each distinct x-vector once; n is its length, S its sums. Principal components of its covariance V are found without
forming V first: a random block of ``components`` + ``oversampling`` directions is multiplied by V in passes over all
rows, each centred before it is multiplied, and made orthonormal after each pass. Rayleigh-Ritz turns the block into
eigenpairs; the pass that gives them also gives their residuals. If those of the wanted components are not at rounding
level after ``passes`` passes, the block expands to the full dimension, where one more pass is exact.

Every pass is one read of the fit list with one partial product per task; these are summed by entry on the executors, so
the driver gets one matrix of dimension times block, however many rows or tasks there are.

Rows whose vector is null or holds a null, NaN or infinite entry, or one of over ``LARGEST`` (whose x would not fit), are
dropped; of vectors of several lengths the most frequent length stays (of ties the longer). Empty vectors have no
dimension and give nothing. Repeated rows are whitened each and fitted once. A null id stays null. Components whose
eigenvalue is zero up to rounding (under ``NIL`` of the trace) can't be whitened and are left out, so with fewer than two
different vectors none is left; an empty table gives an empty one. Components of equal eigenvalues are one basis of their
space. ``deviation`` is null where it is beyond 64 bits. Of extra columns, whatever their names, none is read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .memory import lean
from .tables import settled

COMPONENTS, OVERSAMPLING, PASSES = 16, 16, 4
SCALE, OFFSET, LARGEST = 64, 1_000_000, 2.0**24
#: Eigenvalues below this part of the trace are zero; residuals below this part of the largest eigenvalue are rounding.
NIL, ROUNDING = 1e-12, 1e-13
#: Rows that are one product.
ROWS = 4096


@dataclass
class Model:
    """vectors: one component a column, of unit length; values: their eigenvalues, falling; explained: over the trace."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    passes: int
    identity_error: float


def whole_numbers(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, x: the rows that remain, their entries as whole numbers, all of one length."""
    v = F.col(vector_col)
    odd = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) > LARGEST))
    kept = rows.where(v.isNotNull() & ~odd & (F.size(v) > 0))
    sizes = kept.groupBy(F.size(v).alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()
    x = F.transform(v, lambda c: (F.floor(SCALE * c.cast("double")) + OFFSET).cast("long"))
    return kept.where(F.size(v) == (sizes[0].dims if sizes else 0)).select(F.col(id_col).alias("vec_id"), x.alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _summed(rows: DataFrame, part, kind: str) -> np.ndarray:
    """Sum over all rows of what ``part`` makes of a block of x-vectors: one array per task, summed by entry."""

    def run(batches):
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                one = part(_matrix(batch.column(0).slice(at, ROWS)))
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()])], names=["part"])

    sums = rows.mapInArrow(lean(run), f"part array<{kind}>").select(F.posexplode("part").alias("entry", "v")).groupBy("entry").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(sums), np.int64 if kind == "long" else float)
    for r in sums:
        out[r.entry] = r.v
    return out


def _orthonormal(block: np.ndarray) -> np.ndarray:
    q, _ = np.linalg.qr(block)
    return q


def fit(x: DataFrame, *, components: int = COMPONENTS, oversampling: int = OVERSAMPLING, passes: int = PASSES, seed: int = 7) -> Model | None:
    """Components of the distinct x-vectors of ``x`` (a column x); None if there are no rows."""
    ship(x.sparkSession)
    rows = settled(x.select("x").distinct())
    both = _summed(rows, lambda m: np.concatenate([[len(m)], m.sum(0)]), "long")
    if not len(both) or not both[0]:
        return None
    n, sums = int(both[0]), both[1:]
    d = len(sums)
    centred = lambda m: (m * n - sums) / n  # noqa: E731  exact up to the one division

    def through(q: np.ndarray) -> tuple[np.ndarray, float]:
        """V q, and the trace of V."""

        def part(m: np.ndarray) -> np.ndarray:
            c = centred(m)
            return np.concatenate([(c.T @ (c @ q)).ravel(), [np.square(c).sum()]])

        got = _summed(rows, part, "double") / n
        return got[:-1].reshape(q.shape), got[-1]

    wanted, k = min(components, d), min(components + oversampling, d)
    q = _orthonormal(np.random.default_rng(seed).standard_normal((d, k)))
    done = 0
    while True:
        z, trace = through(q)
        done += 1
        small = q.T @ z
        value, turn = np.linalg.eigh((small + small.T) / 2)
        value, turn = value[::-1], turn[:, ::-1]
        vector = q @ turn
        away = np.linalg.norm(z @ turn - vector * value, axis=0)[:wanted]
        if q.shape[1] == d or away.max(initial=0.0) <= ROUNDING * max(value[0], 0.0):
            break
        if done > passes:
            k = d
            z = np.hstack([z, np.random.default_rng(seed + 1).standard_normal((d, d - z.shape[1]))])
        q = _orthonormal(z)
    value, vector = value[:wanted], vector[:, :wanted] / np.linalg.norm(vector[:, :wanted], axis=0)
    real = value > NIL * trace if trace > 0 else np.zeros(len(value), bool)
    value, vector = value[real], vector[:, real]
    model = Model(n, sums, vector, value, value / trace if trace > 0 else value, done, 0.0)
    r = len(value)
    if r:
        def products(m: np.ndarray) -> np.ndarray:
            w = _whitened(m, model)
            return np.concatenate([w.sum(0), (w.T @ w).ravel()])

        got = _summed(rows, products, "double") / n
        model.identity_error = float(np.abs(got[r:].reshape(r, r) - np.outer(got[:r], got[:r]) - np.eye(r)).max())
    return model


def _whitened(m: np.ndarray, model: Model) -> np.ndarray:
    return (m * model.n - model.sums) / model.n @ model.vectors / np.sqrt(model.values)


def _deviations(m: np.ndarray, model: Model) -> list[int | None]:
    """Sums of (n x - S)² over dimensions, exact; null beyond 64 bits."""
    away = m * model.n - model.sums
    fits = np.square(away.astype(float)).sum(1) < 2.0**62
    sums = np.square(np.where(fits[:, None], away, 0)).sum(1)
    # Near and beyond the limit in numbers of any size.
    return [int(s) if ok else (x if (x := sum(int(u) ** 2 for u in row)) < 2**63 else None) for s, ok, row in zip(sums, fits, away)]


def apply(x: DataFrame, model: Model | None) -> DataFrame:
    """Per row of ``x``: vec_id, deviation and whitened, one entry per component."""
    kind = x.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, deviation long, whitened array<double>"
    if model is None:
        return x.sparkSession.createDataFrame([], schema)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                m = _matrix(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_deviations(m, model), pa.int64()), pa.array(list(_whitened(m, model)), pa.list_(pa.float64()))], names=["vec_id", "deviation", "whitened"])

    return x.select("vec_id", "x").mapInArrow(lean(run), schema)


def whiten(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", **how) -> tuple[DataFrame, Model | None]:
    """Whitened rows (vec_id, deviation, whitened) and the model they come from."""
    x = whole_numbers(rows, id_col=id_col, vector_col=vector_col)
    model = fit(x, **how)
    return apply(x, model), model


def long_form(rows: DataFrame, model: Model | None) -> DataFrame:
    """One row for each of ``whiten``'s rows and component, with the model's figures beside it."""
    figures = F.array(*[F.struct(F.lit(k + 1).alias("component"), F.lit(float(e)).alias("explained")) for k, e in enumerate(model.explained)]) if model is not None and len(model.explained) else F.array().cast("array<struct<component:int,explained:double>>")
    each = rows.select("vec_id", "deviation", F.explode(F.arrays_zip("whitened", figures.alias("figures"))).alias("at"))
    error, n = (model.identity_error, model.n) if model is not None else (0.0, 0)
    return each.select("vec_id", F.col("at.figures.component").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", F.col("at.whitened").alias("whitened"), F.col("at.figures.explained").alias("explained"), F.lit(error).alias("identity_error"))
