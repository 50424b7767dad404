import itertools
import random
from collections import deque

import pytest

from quillgraph.operators import graph


@pytest.fixture(scope="module")
def edges(spark):
    rnd = random.Random(4)
    pairs = {(f"n{rnd.randrange(14)}", f"n{rnd.randrange(14)}") for _ in range(24)} | {("z1", "z2"), ("z2", "z3"), ("z1", "z3"), ("l", "l")}
    return spark.createDataFrame([(a, b, "t", float(rnd.randint(1, 5))) for a, b in sorted(pairs)], "src string, dst string, type string, weight double")


def near(edges):
    out = {}
    for r in edges.collect():
        if r.src != r.dst:
            out.setdefault(r.src, set()).add(r.dst)
            out.setdefault(r.dst, set()).add(r.src)
    return out


def hops(adj, source):
    seen, todo = {source: 0}, deque([source])
    while todo:
        v = todo.popleft()
        for w in adj[v]:
            if w not in seen:
                seen[w] = seen[v] + 1
                todo.append(w)
    return seen


def test_components(edges):
    adj = near(edges)
    assert {r.node: r.component for r in graph.components(edges).collect()} == {v: min(hops(adj, v)) for v in adj}


def test_k_core(edges):
    adj, core, k = near(edges), {}, 0
    left = {v: set(w) for v, w in adj.items()}
    while left:
        k = max(k, min(map(len, left.values())))
        gone = {v for v, w in left.items() if len(w) <= k}
        core |= dict.fromkeys(gone, k)
        left = {v: w - gone for v, w in left.items() if v not in gone}
    assert {r.node: r.core for r in graph.k_core(edges).collect()} == core


def peeled(pairs):
    """Core numbers by the definition: whatever has fewer than k neighbours goes, for k = 1, 2, ..."""
    left, out, k = {v: {w for e in pairs if v in e for w in e if w != v} for v in {x for e in pairs for x in e}}, {}, 1
    while left:
        low = [v for v, w in left.items() if len(w) < k]
        if not low:
            out |= dict.fromkeys(left, k)
            k += 1
        for v in low:
            for w in left.pop(v):
                if w in left:
                    left[w].discard(v)
    return out


@pytest.mark.parametrize("seed", (1, 2))
def test_k_core_of_chains_trees_and_random_graphs(spark, seed, monkeypatch):
    rnd = random.Random(seed)
    pairs = {tuple(sorted(rnd.sample(range(40), 2))) for _ in range((30, 60, 90, 45)[seed])}
    pairs |= {(100 + k, 101 + k) for k in range(60)} | {(100, 3), (160, 7)} if seed % 2 else {(100 + k, 101 + k) for k in range(60)}  # a chain between nodes, or on its own
    pairs |= {(200, 201 + k) for k in range(12)} | {(300, 301), (301, 302), (300, 302), (302, 303)}
    rounds = []
    real = graph.settled
    monkeypatch.setattr(graph, "settled", lambda df: rounds.append(1) or real(df))
    got = {r.node: r.core for r in graph.k_core(spark.createDataFrame([(a, b, 1.0) for a, b in sorted(pairs)], "src int, dst int, weight double")).collect()}
    assert got == peeled(pairs)
    assert len(rounds) < 90  # four tables a round; a chain of 60 peeled from its ends would take 30 rounds


def test_k_core_of_nothing(spark):
    e = spark.createDataFrame([("a", "a", 1.0)], "src string, dst string, weight double")
    assert graph.k_core(e).count() == 0 and graph.betweenness(e).count() == 0


def test_betweenness(edges):
    check_betweenness(edges, {"at_once": 6})
    check_betweenness(edges, {"error": 1e-4})  # all sources, as the bound asks for more than there are


def test_sampled_betweenness_keeps_its_bound(spark):
    rnd = random.Random(9)
    ring = [(k, (k + d) % 60, 1.0) for k in range(60) for d in (1, 2)] + [(60, rnd.randrange(60), 1.0) for _ in range(9)]
    e = spark.createDataFrame(ring, "src int, dst int, weight double")
    exact = {r.node: r.score for r in graph.betweenness(e).collect()}
    near = {r.node: r.score for r in graph.betweenness(e, error=0.4).collect()}
    assert graph.sources_for(61, 0.4) < 61 and set(near) == set(exact)
    assert max(abs(near[v] - exact[v]) for v in exact) <= 2 * 0.4
    assert near != exact


def check_betweenness(edges, how):
    adj = near(edges)
    n, want = len(adj), dict.fromkeys(adj, 0.0)
    for s, t in itertools.permutations(adj, 2):
        d = hops(adj, s)
        if t in d:
            paths = [[t]]
            while len(paths[0]) <= d[t]:
                paths = [[w, *p] for p in paths for w in adj[p[0]] if d.get(w) == d[p[0]] - 1]
            for p in paths:
                for v in p[1:-1]:
                    want[v] += 1 / len(paths)
    got = {r.node: r.score for r in graph.betweenness(edges, **how).collect()}
    assert got == pytest.approx({v: x * 2 / ((n - 1) * (n - 2)) for v, x in want.items()})


def test_clustering(edges):
    adj = near(edges)
    want = {v: sum(b in adj[a] for a, b in itertools.combinations(adj[v], 2)) * 2 / (len(adj[v]) * (len(adj[v]) - 1)) for v in adj if len(adj[v]) > 1}
    assert {r.node: r.coefficient for r in graph.clustering(edges).collect()} == pytest.approx(want)


def test_traverse_and_rank(spark, edges):
    adj = near(edges)
    start = sorted(adj)[0]
    assert {r.node: r.hops for r in graph.traverse(edges, [start], depth=2).collect()} == {v: d for v, d in hops(adj, start).items() if d <= 2}
    score = {r.node: r.score for r in graph.personalised_pagerank(edges, [start, "nobody"], rounds=30, tolerance=1e-9).collect()}
    assert sum(score.values()) == pytest.approx(1) and score["z1"] == 0 and max(score, key=score.get) == start
    assert graph.personalised_pagerank(edges, ["nobody"]).count() == 0


def test_communities_by_modularity_gain(spark):
    """A ring of cliques, and a graph small enough to try every partition."""
    ring = [(10 * c + i, 10 * c + j, "t", 1.0) for c in range(6) for i in range(5) for j in range(i)] + [(10 * c, 10 * ((c + 1) % 6) + 1, "t", 1.0) for c in range(6)]
    e = spark.createDataFrame(ring, "src long, dst long, type string, weight double")
    found = {}
    for r in graph.communities(e).collect():
        found.setdefault(r.community, set()).add(r.node // 10)
    assert len(found) == 6 and all(len(c) == 1 for c in found.values())
    small = [(1, 2, 3.0), (2, 3, 2.0), (1, 3, 2.0), (3, 4, 1.0), (4, 5, 3.0), (5, 6, 2.0), (4, 6, 2.0), (6, 7, 1.0)]
    e = spark.createDataFrame([(a, b, "t", w) for a, b, w in small], "src long, dst long, type string, weight double")
    whole = sum(w for *_, w in small)

    def q(label):
        degree = {}
        for a, b, w in small:
            for n in (a, b):
                degree[label[n]] = degree.get(label[n], 0) + w
        return sum(w for a, b, w in small if label[a] == label[b]) / whole - sum((d / (2 * whole)) ** 2 for d in degree.values())

    best = max(q(dict(zip(range(1, 8), p))) for p in itertools.product(range(3), repeat=7))
    got = {r.node: r.community for r in graph.communities(e).collect()}
    assert q(got) >= best - 0.03 and len(got) == 7
    assert graph.communities(e.limit(0)).count() == 0


def test_communities_and_modularity(spark):
    cliques = [(f"{c}{i}", f"{c}{j}", "t", 1.0) for c in "ab" for i in range(5) for j in range(i)] + [("a0", "b0", "t", 0.1)]
    e = spark.createDataFrame(cliques, "src string, dst string, type string, weight double")
    found = graph.communities(e)
    groups = {}
    for r in found.collect():
        groups.setdefault(r.community, set()).add(r.node[0])
    assert len(groups) == 2 and all(len(g) == 1 for g in groups.values())
    assert graph.modularity(e, found).first().q == pytest.approx(0.49, abs=0.02)
    assert {r.coefficient for r in graph.clustering(e).where("node like '%1'").collect()} == {1.0}
    assert graph.importance(e).orderBy("importance").collect()[-1].node in ("a0", "b0")
