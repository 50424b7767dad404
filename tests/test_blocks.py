"""Graph algorithms over packed blocks against those over tables, on graphs of many blocks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.operators import blocks, graph


@pytest.fixture(scope="module")
def edges(spark):
    rnd = random.Random(11)
    pairs = {(f"p{rnd.randrange(90)}", f"s{rnd.randrange(12)}") for _ in range(260)} | {(f"c{k}", f"n{k % 5}") for k in range(60)} | {(f"s{k}", f"n{k % 5}") for k in range(12)}
    pairs |= {(f"x{k}", f"x{k + 1}") for k in range(8)} | {("l", "l")}  # a chain of its own
    return spark.createDataFrame([(a, b, "t", float(rnd.randint(1, 5))) for a, b in sorted(pairs)] * 2, "src string, dst string, type string, weight double").repartition(5)


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(blocks, "ENTRIES", 40)
    monkeypatch.setattr(blocks, "DEALT", 70)


def rows(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


def test_full_analysis_numbers_the_graph_once(edges, monkeypatch):
    """degrees, cores and components came from three readings of the edges, each round a join of strings."""
    numberings = []
    real = blocks.numbered
    monkeypatch.setattr(blocks, "numbered", lambda *a: numberings.append(1) or real(*a))
    got = rows(graph.analysis(edges).select("node", "centrality", "core", "component"))
    assert len(numberings) == 1
    want = graph.degree_centrality(edges).join(graph._k_core(edges), "node").join(graph._components(edges), "node")
    assert got == rows(want.select("node", "centrality", "core", "component"))


def test_graphs_of_more_nodes_go_by_tables(edges, monkeypatch):
    near = rows(graph.k_core(edges)), rows(graph.components(edges))
    monkeypatch.setattr(blocks, "MOST_NODES", 3)
    assert near == (rows(graph.k_core(edges)), rows(graph.components(edges)))


def test_equal_hashes_get_another_seed(spark, edges, monkeypatch):
    real = F.xxhash64
    monkeypatch.setattr(blocks.F, "xxhash64", lambda c, seed: F.when(seed == 0, F.lit(7).cast("long")).otherwise(real(c, seed)))
    assert rows(graph.components(edges)) == rows(graph._components(edges))


def packed(seed, n=70, m=160):
    """Neighbours of a random graph in several parts, with a hub."""
    rnd = np.random.default_rng(seed)
    m_ = np.zeros((n, n), bool)
    m_[rnd.integers(0, n - 10, m), rnd.integers(0, n - 10, m)] = True
    m_[0, 1:40] = True
    m_ |= m_.T
    np.fill_diagonal(m_, False)
    degree = m_.sum(1).astype(np.int32)
    return m_, np.cumsum(degree) - degree, degree, np.nonzero(m_)[1].astype(np.int32)


@pytest.mark.parametrize("seed", [1, 2])
def test_dependencies_of_a_source(seed):
    """shares of shortest paths through each node, by counting paths between all pairs."""
    m, start, degree, near = packed(seed)
    n = len(m)
    far, paths = np.where(np.eye(n, dtype=bool), 0, -1), np.eye(n)
    front = np.eye(n)
    for k in range(1, n):
        front = np.where(far < 0, front @ m, 0)
        far[front > 0], paths = k, paths + front
    for s in range(n):
        want = np.zeros(n)
        for t in np.flatnonzero(far[s] > 0):
            between = (far[s] > 0) & (far[:, t] > 0) & (far[s] + far[:, t] == far[s, t])
            want[between] += paths[s, between] * paths[between, t] / paths[s, t]
        assert blocks.dependencies(start, degree, near, s) == pytest.approx(want)


def test_best_moves_by_modularity_gain():
    """gains of a block's nodes, against the definition."""
    m, start, degree, near = packed(5)
    rnd = np.random.default_rng(5)
    w = np.triu(rnd.integers(1, 5, m.shape)) * m
    w = (w + w.T).astype(float)
    n, k = len(m), w.sum(1)
    label = rnd.integers(0, 6, n).astype(np.int32)
    total = np.bincount(label, k, n)
    for at in range(3):
        mine = np.arange(at, n, 3)
        weights = np.concatenate([w[v, near[start[v] : start[v] + degree[v]]] for v in mine])
        beside = np.concatenate([near[start[v] : start[v] + degree[v]] for v in mine])
        best, wants = blocks.best_moves(at, 3, degree[mine], beside, weights, label, total, k, k.sum(), 1.0)
        for v, c, moves in zip(mine, best, wants):
            gain = {d: round(w[v, label == d].sum() - k[v] * (total[d] - (d == label[v]) * k[v]) / k.sum(), 9) for d in {label[v], *label[m[v]]}}
            assert (c, moves) == (min(gain, key=lambda d: (-gain[d], d)), max(gain.values()) > gain[label[v]])
