"""Graph patterns and closures against brute force over lists of triples."""

import itertools
import random

import pytest

from quillgraph.operators.closure import closure
from quillgraph.operators.patterns import Graph, P, is_variable

ROWS = [("a", "knows", "b"), ("b", "knows", "c"), ("c", "knows", "a"), ("c", "knows", "d"), ("a", "age", "3"), ("d", "age", "4"), ("d", "likes", "d"), ("e", "likes", "a"), ("e", "mail", "x")]


@pytest.fixture(scope="module")
def graph(spark):
    return Graph(spark.createDataFrame(ROWS, "s string, p string, o string"))


def solve(patterns, rows=ROWS):
    """All bindings, by trying every triple for every pattern."""
    out = [{}]
    for pattern in patterns:
        out = [dict(b, **new) for b in out for t in rows for new in [fit(pattern, t, b)] if new is not None]
    return out


def fit(pattern, triple, bound):
    new = {}
    for x, v in zip(pattern, triple):
        if is_variable(x):
            if {**bound, **new}.get(x[1:], v) != v:
                return None
            new[x[1:]] = v
        elif x != v:
            return None
    return new


def rows(frame):
    return sorted(tuple(sorted((k, v) for k, v in r.asDict().items() if v is not None)) for r in frame.collect())


def plain(bindings):
    return sorted(tuple(sorted(b.items())) for b in bindings)


@pytest.mark.parametrize("patterns", [
    [("?x", "knows", "?y")], [("?x", "knows", "?y"), ("?y", "knows", "?z")], [("?x", "?p", "?x")], [("?x", "knows", "?y"), ("?y", "age", "?n"), ("?x", "?q", "?v")],
    [("c", "knows", "?y"), ("?y", "age", "4")], [("?x", "knows", "?y"), ("?y", "knows", "?z"), ("?z", "knows", "?x")],
])
def test_groups_of_patterns(graph, patterns):
    assert rows(graph.match(*patterns).frame) == plain(solve(patterns))


def test_optional_minus_and_exists(graph):
    base = [("?x", "knows", "?y")]
    want = [b2 for b in solve(base) for b2 in ([dict(b, **f) for t in ROWS for f in [fit(("?y", "age", "?n"), t, b)] if f is not None] or [b])]
    assert rows(graph.match(*base).optional(("?y", "age", "?n")).frame) == plain(want)
    # The condition of an optional part sees both sides and drops only what is optional.
    got = graph.match(*base).optional(("?y", "age", "?n"), where="n > 3 and x <> 'b'").frame
    assert rows(got) == plain([b | ({"n": "4"} if b["y"] == "d" else {}) for b in solve(base)])
    with_age = {b["y"] for b in solve([("?y", "age", "?n")])}
    assert rows(graph.match(*base).minus(("?y", "age", "?n")).frame) == plain([b for b in solve(base) if b["y"] not in with_age])
    assert rows(graph.match(*base).exists(("?y", "age", "?n")).frame) == plain([b for b in solve(base) if b["y"] in with_age])
    assert rows(graph.match(*base).minus(("?q", "age", "?n")).frame) == plain(solve(base))


def test_unbound_variables_fit_any_value_beside_a_bound_one(graph):
    some = graph.match(("?x", "knows", "?y")).optional(("?x", "age", "?n"))
    got = some.match(("?y", "age", "?n")).frame
    # a knows b (b has no age); c knows a and d, and c has no age, so n comes from y.
    assert rows(got) == plain([{"x": "c", "y": "a", "n": "3"}, {"x": "c", "y": "d", "n": "4"}])
    assert rows(some.minus(("?y", "age", "?n")).frame) == plain([{"x": "a", "y": "b", "n": "3"}, {"x": "b", "y": "c"}])


def test_unions_values_groups_and_questions(graph):
    both = graph.match(("?x", "likes", "?y")).union(graph.match(("?x", "mail", "?m")))
    assert rows(both.frame) == plain([{"x": "d", "y": "d"}, {"x": "e", "y": "a"}, {"x": "e", "m": "x"}]) and both.unbound == {"y", "m"}
    assert rows(graph.match(("?x", "knows", "?y")).values("x", ["a", "zz"]).frame) == plain([{"x": "a", "y": "b"}])
    assert graph.match(("a", "knows", "?y")).ask().first().found and not graph.match(("a", "hates", "?y")).ask().first().found
    with pytest.raises(ValueError):
        graph.match(("?x", "knows", "?y"), ("?v", "age", "?w"))


def walk(path, rows=ROWS):
    """Pairs by the definition of each kind of path; closures as sets."""
    nodes = {x for s, _, o in rows for x in (s, o)}
    if path.kind == "edge":
        return [(s, o) for s, p, o in rows if p == path.name]
    inner = [walk(x, rows) for x in path.parts]
    if path.kind == "inverse":
        return [(b, a) for a, b in inner[0]]
    if path.kind == "either":
        return inner[0] + inner[1]
    if path.kind == "sequence":
        return [(a, d) for a, b in inner[0] for c, d in inner[1] if b == c]
    edge, found, now = set(inner[0]), set(), {(n, n) for n in nodes}
    for k in range((path.most if path.most is not None else path.least + len(nodes) ** 2) + 1):
        if k >= path.least:
            found |= now
        now = {(a, d) for a, b in now for c, d in edge if b == c}
    return sorted(found)


@pytest.mark.parametrize("path", [P("knows") / P("knows"), ~P("knows"), P("knows") | ~P("likes"), P("knows").plus(), P("knows").star(), P("likes").maybe(), P("knows").times(2, 3), (P("knows") | P("likes")).plus() / P("age"), ~(P("knows") / P("age")), ~P("knows").plus()])
def test_paths(graph, path):
    want = sorted(walk(path))
    assert sorted((r.x, r.y) for r in graph.match(("?x", path, "?y")).frame.collect()) == want
    assert sorted(r.y for r in graph.match(("a", path, "?y")).frame.collect()) == sorted(b for a, b in want if a == "a")
    assert sorted(r.x for r in graph.match(("?x", path, "d")).frame.collect()) == sorted(a for a, b in want if b == "d")
    seeded = graph.match(("?x", "age", "?n")).match(("?x", path, "?y")).frame
    assert sorted((r.x, r.y) for r in seeded.collect()) == [w for w in want if w[0] in ("a", "d")]


def test_construct_and_update(graph):
    made = graph.match(("?x", "knows", "?y")).optional(("?y", "age", "?n")).construct(("?y", "knownBy", "?x"), ("?x", "friendAge", "?n"))
    assert sorted(map(tuple, made.collect())) == sorted({(o, "knownBy", s) for s, p, o in ROWS if p == "knows"} | {("c", "friendAge", "3"), ("c", "friendAge", "4")})
    after = graph.update(graph.match(("?x", "age", "?n")), delete=[("?x", "age", "?n")], insert=[("?x", "was", "?n")])
    assert sorted(map(tuple, after.collect())) == sorted([r for r in ROWS if r[1] != "age"] + [("a", "was", "3"), ("d", "was", "4")])
    assert graph.insert_data([ROWS[0], ("z", "p", "q")]).count() == len(ROWS) + 1


def test_closure_with_cycles_and_long_chains(spark):
    rnd = random.Random(5)
    pairs = {(rnd.randrange(12), rnd.randrange(12)) for _ in range(18)} | {(k, k + 1) for k in range(20, 60)} | {(59, 40)}
    frame = spark.createDataFrame([*sorted(pairs), (None, 1)], "a int, b int")
    want, now, hop = {}, {(a, b) for a, b in pairs}, 1
    while now:
        want |= dict.fromkeys(now, hop)
        now, hop = {(a, d) for (a, b), (c, d) in itertools.product(now, pairs) if b == c} - set(want), hop + 1
    assert {(r.a, r.b): r.hops for r in closure(frame).collect()} == want
    starts = spark.createDataFrame([(20,), (3,)], "a int")
    assert {(r.a, r.b): r.hops for r in closure(frame, starts=starts, most=7).collect()} == {k: h for k, h in want.items() if k[0] in (20, 3) and h <= 7}
    assert {(r.a, r.b) for r in closure(frame, starts=starts, least=0, most=0).collect()} == {(20, 20), (3, 3)}
    assert closure(frame.limit(0)).count() == 0
