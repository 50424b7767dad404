import math

import numpy as np
import pytest

from quillgraph.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x string, deviation int"


def frame(spark, vectors, first=0):
    return spark.createDataFrame([(first + i, None if v is None else [None if c is None else float(c) for c in v], "x", 1) for i, v in enumerate(vectors)], SCHEMA).repartition(3)


def plain(vectors):
    """Everything from the definition, with the covariance formed."""
    good = [v for v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in good]
    fit = sorted({tuple(r) for r in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    c = (np.array(fit, object) * n - np.array(sums, object)).astype(float) / n
    v = c.T @ c / n
    value, vector = np.linalg.eigh(v)
    deviation = [sum((n * a - s) ** 2 for a, s in zip(r, sums)) for r in x]
    centred = (np.array(x, object) * n - np.array(sums, object)).astype(float) / n
    return n, deviation, value[::-1], vector[:, ::-1], centred, np.trace(v)


def compare(spark, vectors, **how):
    rows, model = whitening.whiten(frame(spark, vectors), **how)
    n, deviation, value, vector, centred, trace = plain(vectors)
    k = len(model.values)
    assert model.n == n and model.identity_error < 1e-8
    assert model.values == pytest.approx(value[:k], rel=1e-10) and model.explained == pytest.approx(value[:k] / trace, rel=1e-10)
    got = {r.vec_id: r for r in rows.collect()}
    ids = [i for i, v in enumerate(vectors) if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    assert sorted(got) == ids
    want = centred @ vector[:, :k] / np.sqrt(value[:k])
    sign = np.sign((vector[:, :k] * model.vectors).sum(0))
    for row, i in enumerate(ids):
        assert got[i].deviation == deviation[row]
        assert got[i].whitened == pytest.approx(want[row] * sign, abs=1e-7)
    return model


def spectrum(rng, rows, dims, fall):
    return rng.standard_normal((rows, dims)) * 4 * fall ** np.arange(dims) @ np.linalg.qr(rng.standard_normal((dims, dims)))[0]


def test_steep_spectrum_needs_no_full_dimension(spark):
    rng = np.random.default_rng(3)
    vectors = (spectrum(rng, 400, 48, 1.0) * 0.02 + spectrum(rng, 400, 48, 0.6)).tolist()
    model = compare(spark, vectors, components=4, oversampling=20, passes=30)
    assert model.passes <= 31 and len(model.values) == 4


def test_flat_spectrum_expands_to_full_dimension(spark):
    vectors = np.random.default_rng(4).standard_normal((300, 40)).tolist()
    model = compare(spark, vectors)
    assert model.passes == whitening.PASSES + 2 and len(model.values) == 16


def test_odd_rows_and_copies(spark):
    rng = np.random.default_rng(5)
    vectors = spectrum(rng, 60, 6, 0.8).tolist()
    vectors += [vectors[3]] * 50 + [None, [1.0, None, 0, 0, 0, 0], [float("nan")] * 6, [float("inf")] * 6, [-0.01] * 6]
    assert len(compare(spark, vectors).values) == 6
    # Other lengths than the most frequent one, ids that are null or repeated, and entries too large.
    rows, model = whitening.whiten(frame(spark, vectors + [[1.0], [], [1e30] * 6]).unionAll(spark.createDataFrame([(None, [1.0] * 6, "", 1), (0, [2.0] * 6, "", 1)], SCHEMA)))
    assert rows.count() == 60 + 50 + 1 + 2 and rows.where("vec_id is null").count() == 1 and model.n == 63


def test_fewer_directions_than_dimensions(spark):
    line = [[k, 2 * k, 0.0, 0.0] for k in range(9)]
    rows, model = whitening.whiten(frame(spark, line))
    assert len(model.values) == 1 and rows.count() == 9 and model.explained[0] == pytest.approx(1)
    long = whitening.long_form(rows, model)
    assert long.count() == 9 and {r.component for r in long.collect()} == {1}


def test_nothing_to_whiten(spark):
    for vectors in ([], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 3):
        rows, model = whitening.whiten(frame(spark, vectors) if vectors else frame(spark, [[1.0]]).limit(0))
        assert whitening.long_form(rows, model).count() == 0


def test_deviation_beyond_64_bits_is_null(spark):
    rows, _ = whitening.whiten(frame(spark, [[2.0**24], [-(2.0**24)], [0.0], [1.0]]))
    got = {r.vec_id: r.deviation for r in rows.collect()}
    x = {0: 2**30, 1: -(2**30), 2: 0, 3: 64}
    want = {i: (4 * v - 64) ** 2 for i, v in x.items()}
    assert got == {i: w if w < 2**63 else None for i, w in want.items()} and got[0] is None
