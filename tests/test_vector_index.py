"""The index and the nearest-neighbour join against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.operators import vector_index
from quillgraph.operators.vector_index import VectorIndex, nearest_join


def clustered(seed, clusters, each, dims, spread):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((clusters, dims))
    return np.concatenate([c + spread * rng.standard_normal((each, dims)) for c in centres])


def frame(spark, m, labels=4):
    return spark.createDataFrame([(i, [float(x) for x in v], i % labels) for i, v in enumerate(m)], "vec_id long, v array<double>, label int").repartition(3)


def all_pairs(m, queries, k, allowed=None, but_self=False):
    u = vector_index.unit(np.asarray(m, float))
    out = {}
    for q in queries:
        s = u @ u[q]
        ids = [i for i in range(len(u)) if (allowed is None or i in allowed) and not (but_self and i == q)]
        out[q] = sorted(ids, key=lambda i: (-round(float(s[i]), 12), i))[:k], s
    return out


def found(df):
    got = {}
    for r in df.collect():
        got.setdefault(r["query"], []).append((-r.similarity, r.id))
    return {q: sorted(x) for q, x in got.items()}


def same(got, want, k):
    """The same similarities in order; the same ids but where similarities tie up to rounding."""
    for q, (ids, s) in want.items():
        assert [-x for x, _ in got[q]] == pytest.approx([s[i] for i in ids], abs=1e-9)
        assert all(abs(s[i] + x) < 1e-9 for x, i in got[q]) and len({i for _, i in got[q]}) == len(ids)


@pytest.fixture(scope="module")
def data():
    return clustered(1, 30, 40, 24, 0.25)


@pytest.fixture(scope="module")
def index(spark, data, tmp_path_factory):
    return VectorIndex.build(frame(spark, data), "file://" + str(tmp_path_factory.mktemp("index") / "a"))


def test_recall_of_some_lists_and_exact_search(spark, data, index):
    queries = frame(spark, data).where("vec_id % 50 = 0")
    want = all_pairs(data, range(0, len(data), 50), 10)
    some = found(index.search(queries, 10, probes=4))
    hits = sum(len({i for _, i in some[q]} & set(ids)) for q, (ids, _) in want.items())
    assert hits >= 0.9 * 10 * len(want)
    same(found(index.search(queries, 10, probes=None)), want, 10)
    allowed = {i for i in range(len(data)) if i % 4 in (1, 2)}
    same(found(index.search(queries, 7, probes=None, types=[1, 2])), all_pairs(data, range(0, len(data), 50), 7, allowed), 7)


def test_files_read_follow_the_probes(spark, data, index):
    lists = index.rows().select("list").distinct().count()
    files = {r["list"] for r in index.rows().select("list").distinct().collect()}
    one = frame(spark, data).where("vec_id = 0")
    asked = index._queries(one, "vec_id", "v")
    ranges = vector_index._ranges(index.rows())
    for probes in (1, 3):
        dealt = index._dealt(asked, ranges, probes, None)
        wanted = [r["list"] for r in dealt.collect()]
        read = index.rows().where(F.col("list").isin(wanted))
        assert len(wanted) == probes and {f.split("list=")[1].split("/")[0] for f in (r.f for r in read.select(F.input_file_name().alias("f")).distinct().collect())} == {str(w) for w in wanted}
        assert "PartitionFilters: [isnotnull" in read._jdf.queryExecution().toString() or "PartitionFilters: [list" in read._jdf.queryExecution().toString()
    assert lists == len(files) > 20


def test_append_load_and_rebuild(spark, data, tmp_path):
    path = "file://" + str(tmp_path / "b")
    VectorIndex.build(frame(spark, data).where("vec_id < 700"), path).append(frame(spark, data).where("vec_id >= 700"))
    loaded = VectorIndex(spark, path)
    queries = frame(spark, data).where("vec_id % 100 = 3")
    want = all_pairs(data, range(3, len(data), 100), 5)
    same(found(loaded.search(queries, 5, probes=None)), want, 5)
    again = loaded.rebuild("file://" + str(tmp_path / "c"))
    assert again.rows().count() == len(data)
    same(found(again.search(queries, 5, probes=None)), want, 5)


def test_join_equals_all_pairs_and_compares_few(spark):
    data = clustered(2, 40, 30, 16, 0.05)
    near, compared = nearest_join(frame(spark, data), 6)
    same(found(near), all_pairs(data, range(len(data)), 6, but_self=True), 6)
    assert compared < 0.25 * len(data) ** 2


def test_join_of_copies_odd_rows_and_flat_data(spark):
    rng = np.random.default_rng(3)
    data = np.concatenate([rng.standard_normal((60, 8)), np.tile(rng.standard_normal((1, 8)), (50, 1)), np.zeros((2, 8))])
    rows = frame(spark, data).unionByName(spark.createDataFrame([(500, None, 1), (501, [1.0], 1), (502, [1.0, None, *[0.0] * 6], 1)], "vec_id long, v array<double>, label int"))
    near, _ = nearest_join(rows, 5, lists=6)
    got = found(near)
    assert set(got) == set(range(len(data)))
    same(got, all_pairs(data, range(len(data)), 5, but_self=True), 5)
    assert [i for _, i in got[100]] == [60, 61, 62, 63, 64] and [i for _, i in got[61]] == [60, 62, 63, 64, 65]
    assert nearest_join(rows.limit(0), 5)[0].count() == 0


def test_join_in_tiles_of_bounded_size(spark, monkeypatch):
    """all queries that a list was dealt were rows of one task."""
    from quillgraph.operators import vector_index

    monkeypatch.setattr(vector_index, "TILE", 64)
    real, sizes = vector_index._near_tiles, []

    def watched(*a):
        tiles, *rest = real(*a)
        sizes.extend(len(r.ids) // 8 for r in tiles.select("ids").collect())
        return tiles, *rest

    monkeypatch.setattr(vector_index, "_near_tiles", watched)
    rng = np.random.default_rng(8)
    data = np.concatenate([rng.standard_normal((200, 8)), 3 + rng.standard_normal((120, 8)) / 9])
    near, _ = nearest_join(frame(spark, data), 4, lists=5)
    same(found(near), all_pairs(data, range(len(data)), 4, but_self=True), 4)
    assert sum(sizes) == len(data) and max(sizes) <= 128 and len(sizes) >= 5
