"""Whole-graph algorithms over edge tables (src, dst, weight).

Components, cores, communities and betweenness go by packed blocks of numbered nodes (see ``blocks``). Graphs of more
nodes than those take go by loops of joins and aggregations, as the other algorithms do: every round is a DataFrame plan
whose result is written to the shared folder, so lineage stays short and lost executors cost one round at most, and
nothing is collected but counts and convergence figures.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks
from .closure import closure
from .lineage import dropped, settled


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of each edge, once, without loops: a, b."""
    one = edges.where("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return one.union(one.select("b", "a")).distinct()


def transitions(edges: DataFrame) -> DataFrame:
    """a, b, p: the chance of each step from a, by weight; both directions, parallel edges as their largest weight."""
    one = edges.where("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b"), "weight")
    both = one.union(one.select("b", "a", "weight")).groupBy("a", "b").agg(F.max("weight").alias("weight"))
    total = both.groupBy("a").agg(F.sum("weight").alias("total"))
    return both.join(total, "a").where("total > 0").select("a", "b", (F.col("weight") / F.col("total")).alias("p"))


def _labelled(g: blocks.Blocks, name: str, label: np.ndarray, **values: np.ndarray) -> DataFrame:
    """node, other values, and the name of the node that is each one's label."""
    numbers = g.named(at_=label, id_=np.arange(g.n, dtype=np.int32), **values)
    roots = numbers.where("id_ = at_").select("at_", F.col("node").alias(name))
    roots = F.broadcast(roots) if len(np.unique(label)) <= 100_000 else roots
    out = settled(numbers.join(roots, "at_").select("node", *values, name))
    dropped(numbers)
    g.drop()
    return out


def components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node that undirected edges reach; by smallest labels and pointer jumping."""
    g = blocks.numbered(edges)
    return _components(edges) if g is None else _labelled(g, "component", blocks.components(g))


def _components(edges: DataFrame) -> DataFrame:
    """Components by joins."""
    pairs = settled(undirected(edges))
    label = settled(pairs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")))
    while True:
        far = pairs.join(label.toDF("b", "c"), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("m"))
        near = label.join(far, "node").select("node", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        jump = label.toDF("component", "next")
        new = settled(near.join(jump, "component", "left").select("node", "old", F.least("component", F.coalesce("next", "component")).alias("component")))
        dropped(label)
        if new.where("old <> component").isEmpty():
            dropped(pairs)
            return new.select("node", "component")
        label = new.select("node", "component")
        label.settled_at = new.settled_at


def personalised_pagerank(edges: DataFrame, entries: list, *, alpha: float = 0.15, rounds: int = 10, tolerance: float | None = None) -> DataFrame:
    """node, score after ``rounds`` steps of a walk that returns to the entry nodes with chance ``alpha``.

    With ``tolerance``, stops early once no score moves by more. Entry nodes that the graph lacks are left out; with
    none left there is no walk and the result is empty.
    """
    steps = settled(transitions(edges))
    nodes = steps.select(F.col("a").alias("node")).distinct()
    start = nodes.where(F.col("node").isin(entries))
    n = start.count()
    if not n:
        return nodes.limit(0).select("node", F.lit(0.0).alias("score"))
    home = start.select("node", F.lit(1.0 / n).alias("home"))
    score = settled(nodes.join(F.broadcast(home), "node", "left").select("node", F.coalesce("home", F.lit(0.0)).alias("home"), F.coalesce("home", F.lit(0.0)).alias("score")))
    for _ in range(rounds):
        moved = score.join(steps, score.node == steps.a).groupBy(F.col("b").alias("node")).agg(F.sum(F.col("score") * F.col("p")).alias("in"))
        new = settled(score.join(moved, "node", "left").select("node", "home", F.col("score").alias("old"), (alpha * F.col("home") + (1 - alpha) * F.coalesce("in", F.lit(0.0))).alias("score")))
        moved_most = new.agg(F.max(F.abs(F.col("score") - F.col("old")))).first()[0] if tolerance is not None else None
        dropped(score)
        score = new.select("node", "home", "score")
        score.settled_at = new.settled_at
        if moved_most is not None and moved_most < tolerance:
            break
    dropped(steps)
    return score.select("node", "score")


def _two_core(pairs: DataFrame) -> DataFrame:
    """node: those on cycles or between cycles, by rake and compress.

    A round takes all leaves away and puts one edge in place of some nodes of degree two (no two of them neighbours), so
    chains shrink by a share of their nodes each round, however long they are; what is left in the end, with the nodes
    on the chains that its edges stand for, is the 2-core. ``pairs``: a, b in both directions.
    """
    edges = settled(pairs.where("a < b").select(F.concat_ws("\u0001", "a", "b").alias("e"), F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b")))
    stands: list[DataFrame] = []
    while True:
        ends = edges.select("e", F.explode(F.array("a", "b")).alias("node"))
        degree = settled(ends.groupBy("node").agg(F.count("*").alias("d"), F.min("e").alias("e1"), F.max("e").alias("e2")))
        leaf = degree.where("d = 1").select(F.col("e1").alias("e")).distinct()
        if leaf.isEmpty():
            dropped(degree)
            break
        raked = edges.join(leaf, "e", "left_anti")
        # A node of degree two goes if its two edges stay and no neighbour of degree two has a smaller hash.
        two = degree.where("d = 2 and e1 <> e2").select("node", "e1", "e2", F.xxhash64("node", F.lit(len(stands))).alias("h"))
        beside = raked.join(two.select(F.col("node").alias("a"), F.col("h").alias("ha")), "a", "left").join(two.select(F.col("node").alias("b"), F.col("h").alias("hb")), "b", "left")
        beside = settled(beside.select("e", "a", "b", F.coalesce("ha", F.lit(2**63 - 1)).alias("ha"), F.coalesce("hb", F.lit(2**63 - 1)).alias("hb")))
        wins = beside.select("e", F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("far"), (F.struct("ha", "a") < F.struct(F.col("hb").alias("ha"), F.col("b").alias("a"))).alias("first")), F.struct(F.col("b").alias("node"), F.col("a").alias("far"), (F.struct(F.col("hb").alias("ha"), F.col("b").alias("a")) < F.struct("ha", "a")).alias("first")))).alias("x")).select("e", "x.*")
        gone = wins.join(two.select("node"), "node", "left_semi").groupBy("node").agg(F.count("*").alias("d"), F.every("first").alias("first"), F.min("e").alias("e1"), F.max("e").alias("e2"), F.min_by("far", "e").alias("a"), F.max_by("far", "e").alias("b")).where("d = 2 and first and e1 <> e2")
        gone = settled(gone.select("node", "e1", "e2", F.concat(F.lit("\u0002"), F.col("node"), F.lit(f"\u0002{len(stands)}")).alias("e"), "a", "b"))
        stands.append(gone)
        old = gone.select(F.explode(F.array("e1", "e2")).alias("e"))
        new = settled(raked.join(old, "e", "left_anti").unionByName(gone.select("e", "a", "b")))
        dropped(edges, degree, beside)
        edges = new
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node"))
    if stands:
        all_gone = settled(reduce(DataFrame.unionByName, stands))
        dropped(*stands)
        stands = [all_gone]
        inside = closure(all_gone.select(F.col("e").alias("a"), F.explode(F.array("e1", "e2")).alias("b")), starts=edges.select(F.col("e").alias("a")), least=0)
        nodes = nodes.unionByName(all_gone.join(inside.select(F.col("b").alias("e")).distinct(), "e", "left_semi").select("node"))
    out = settled(nodes.distinct())
    dropped(edges, *stands)
    return out


def _outside(pairs: DataFrame) -> np.ndarray:
    """Numbers of the nodes outside the 2-core, to nodes of which ``pairs`` are numbers."""
    core = _two_core(pairs)
    out = pairs.select("a").distinct().join(core.select(F.col("node").cast("long").alias("a")), "a", "left_anti").toArrow().column("a").to_numpy()
    dropped(core)
    return out


def k_core(edges: DataFrame) -> DataFrame:
    """node, core: the largest k such that the node is in a part where all have k neighbours or more."""
    g = blocks.numbered(edges)
    if g is None:
        return _k_core(edges)
    out = g.named(core=blocks.cores(g, _outside).astype(np.int64))
    g.drop()
    return out


def _k_core(edges: DataFrame) -> DataFrame:
    """Cores by joins.

    Trees that hang on the graph have 1; the rest starts from its degrees, and each node takes the h-index of what its
    neighbours have (the largest h such that h of them have h or more) until nothing changes. Only neighbours of nodes
    that changed are asked again, and a node's neighbours count by value, so a hub is as many rows as there are values.
    """
    pairs = settled(undirected(edges))
    kind = pairs.schema["a"].dataType
    inside = settled(_two_core(pairs).select(F.col("node").cast(kind).alias("node")))
    kept = settled(pairs.join(inside.toDF("a"), "a", "left_semi").join(inside.toDF("b"), "b", "left_semi"))
    core = settled(kept.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("core")))
    asked = core.select("node")
    while True:
        near = kept.join(asked.toDF("a"), "a", "left_semi").join(core.toDF("b", "theirs"), "b").join(core.toDF("a", "own"), "a")
        counts = near.groupBy(F.col("a").alias("node"), "own", F.least("own", "theirs").alias("v")).agg(F.count("*").alias("n"))
        reach = F.sum("n").over(Window.partitionBy("node").orderBy(F.desc("v")))
        index = counts.select("node", "own", F.least("v", reach).alias("h")).groupBy("node", "own").agg(F.max("h").alias("core"))
        changed = settled(index.where("core < own").select("node", "core"))
        if changed.isEmpty():
            dropped(changed)
            break
        new = settled(core.join(changed.withColumnRenamed("core", "new"), "node", "left").select("node", F.coalesce("new", "core").alias("core")))
        asked = settled(kept.join(changed.select(F.col("node").alias("b")), "b", "left_semi").select(F.col("a").alias("node")).distinct())
        dropped(core, changed)
        core = new
    nodes = pairs.select(F.col("a").alias("node")).distinct()
    out = settled(nodes.join(core, "node", "left").select("node", F.coalesce("core", F.lit(1)).cast("long").alias("core")))
    dropped(pairs, inside, kept, core)
    return out


#: Sources of betweenness that one pass searches from.
SOURCES = 256


def sources_for(nodes: int, error: float, failure: float = 0.05) -> int:
    """Sources after which, by Hoeffding's bound, no score is off by more than ``error`` (of scores in 0 to 1), but with that chance."""
    return math.ceil((math.log(max(nodes, 2)) + math.log(2 / failure)) / (2 * error**2))


def betweenness(edges: DataFrame, *, error: float | None = None, at_once: int = SOURCES) -> DataFrame:
    """node, score: shortest-path betweenness, unweighted, over ordered pairs times 2 / ((n - 1)(n - 2)).

    With ``error``, only as many sources are searched as bound every node's error by that much of 2 (see
    ``sources_for``), in the order of a hash of their names; without, all are.
    """
    g = blocks.numbered(edges)
    score = None if g is None else _between(g, error)
    out = _betweenness(edges, error=error, at_once=at_once) if score is None else g.named(score=score)
    if g is not None:
        g.drop()
    return out


def _between(g: blocks.Blocks, error: float | None) -> np.ndarray | None:
    """Scores of a graph that every worker can hold; else None."""
    n, entries = g.n, int(g.degrees().sum(dtype=np.int64))
    if entries > blocks.MOST_SEARCHED:
        return None
    if not n:
        return np.zeros(0)
    wanted = n if error is None else min(n, sources_for(n, error))
    first = g.names.orderBy(F.md5(F.col("node").cast("string"))).limit(wanted).select("id")
    sources = np.arange(n) if wanted == n else np.array([r.id for r in first.collect()])
    return blocks.owed(g, sources, entries) * (2.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0) * n / wanted


def _betweenness(edges: DataFrame, *, error: float | None = None, at_once: int = SOURCES) -> DataFrame:
    """Betweenness by joins.

    Searches go level by level from ``at_once`` sources together: a level is a table (source, node, shortest paths), and
    the next one is a join with the edges, less the two levels before. Then shares go back from the last level to the
    first by the same joins.
    """
    pairs = settled(undirected(edges))
    nodes = settled(pairs.select(F.col("a").alias("node")).distinct())
    n = nodes.count()
    wanted = n if error is None else min(n, sources_for(n, error))
    place = F.conv(F.substring(F.md5(F.col("node").cast("string")), 1, 13), 16, 10).cast("long")
    rounds = max(1, -(-wanted // at_once))
    if wanted == n:
        chosen = settled(nodes.select("node", F.pmod(place, F.lit(rounds)).alias("round")))
    else:
        chosen = settled(nodes.orderBy(F.md5(F.col("node").cast("string"))).limit(wanted).select("node", F.pmod(place, F.lit(rounds)).alias("round")))
    total = None
    for r in range(rounds):
        part = _owed(pairs, chosen.where(F.col("round") == r).select("node"))
        if part is not None:
            new = settled(part if total is None else total.unionByName(part).groupBy("node").agg(F.sum("owed").alias("owed")))
            dropped(total)
            total = new
    scale = 2.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    if total is None:
        return nodes.select("node", F.lit(0.0).alias("score"))
    return nodes.join(total, "node", "left").select("node", (F.coalesce("owed", F.lit(0.0)) * scale * n / wanted).alias("score"))


def _owed(pairs: DataFrame, sources: DataFrame) -> DataFrame | None:
    """node, owed: over these sources, the sum of shares of shortest paths that pass each other node."""
    levels = [settled(sources.select(F.col("node").alias("source"), "node", F.lit(1.0).alias("paths")))]
    steps = pairs.toDF("node", "next")
    while True:
        reached = levels[-1].join(steps, "node").groupBy("source", F.col("next").alias("node")).agg(F.sum("paths").alias("paths"))
        for before in levels[-2:]:
            reached = reached.join(before.select("source", "node"), ["source", "node"], "left_anti")
        level = settled(reached)
        if level.isEmpty():
            dropped(level)
            break
        levels.append(level)
    owed = [settled(levels[-1].select("source", "node", "paths", F.lit(0.0).alias("owed")))]
    for level in reversed(levels[1:-1]):
        back = owed[-1].select("source", F.col("node").alias("next"), ((1 + F.col("owed")) / F.col("paths")).alias("share"))
        shares = back.join(pairs.toDF("next", "node"), "next").groupBy("source", "node").agg(F.sum("share").alias("share"))
        owed.append(settled(level.join(shares, ["source", "node"], "left").select("source", "node", "paths", (F.col("paths") * F.coalesce("share", F.lit(0.0))).alias("owed"))))
    if len(levels) == 1:
        dropped(*levels, *owed)
        return None
    out = settled(reduce(DataFrame.unionByName, [o.select("node", "owed") for o in owed]).groupBy("node").agg(F.sum("owed").alias("owed")))
    dropped(*levels, *owed)
    return out


def modularity(edges: DataFrame, membership: DataFrame, *, gamma: float = 1.0) -> DataFrame:
    """One row q: sum over communities of inner weight / W - gamma (degree / 2W)^2. ``membership``: node, community."""
    e = edges.where("src <> dst").join(membership.toDF("src", "cs"), "src").join(membership.toDF("dst", "cd"), "dst")
    whole = e.agg(F.sum("weight").alias("whole"))
    inner = e.where("cs = cd").groupBy(F.col("cs").alias("c")).agg(F.sum("weight").alias("inner"))
    degree = e.select(F.col("cs").alias("c"), "weight").union(e.select("cd", "weight")).groupBy("c").agg(F.sum("weight").alias("degree"))
    parts = degree.join(inner, "c", "left").crossJoin(F.broadcast(whole))
    return parts.agg(F.sum(F.coalesce("inner", F.lit(0.0)) / F.col("whole") - gamma * (F.col("degree") / (2 * F.col("whole"))) ** 2).alias("q"))


def _moved(g: DataFrame, gamma: float, rounds: int) -> DataFrame:
    """node, c: labels after moves by modularity gain. ``g``: a, b, w in both directions, loops once with twice their weight.

    Half of the nodes, another half each time, may move in a round, so that neighbours don't swap labels for ever.
    """
    degree = settled(g.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k")))
    whole = degree.agg(F.sum("k")).first()[0] or 1.0
    ties = settled(g.where("a <> b"))
    label = settled(degree.select("node", F.col("node").alias("c"), "k"))
    for r in range(rounds):
        total = label.groupBy("c").agg(F.sum("k").alias("total"))
        links = ties.join(label.select(F.col("node").alias("b"), "c"), "b").groupBy(F.col("a").alias("node"), "c").agg(F.sum("w").alias("w"))
        here = label.select("node", F.col("c").alias("own"), "k")
        asked = links.unionByName(here.select("node", F.col("own").alias("c"), F.lit(0.0).alias("w"))).groupBy("node", "c").agg(F.sum("w").alias("w"))
        rest = F.col("total") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)
        gains = asked.join(here, "node").join(total, "c").select("node", "c", "own", "k", F.round(F.col("w") - gamma * F.col("k") * rest / whole, 9).alias("gain"))
        best = gains.groupBy("node").agg(F.first("k").alias("k"), F.first("own").alias("own"), F.max(F.when(F.col("c") == F.col("own"), F.col("gain"))).alias("stay"), F.min(F.struct((-F.col("gain")).alias("loss"), "c")).alias("best"))
        turn, wants = F.pmod(F.xxhash64("node", F.lit(r)), F.lit(2)) == 0, -F.col("best.loss") > F.col("stay")
        new = settled(best.select("node", F.when(turn & wants, F.col("best.c")).otherwise(F.col("own")).alias("c"), "k", wants.alias("wants")))
        dropped(label)
        label = new.select("node", "c", "k")
        label.settled_at = new.settled_at
        if new.where("wants").isEmpty():
            break
    dropped(degree, ties)
    out = label.select("node", "c")
    out.settled_at = label.settled_at
    return out


def communities(edges: DataFrame, *, gamma: float = 1.0, rounds: int = 16) -> DataFrame:
    """node, community (its smallest node): nodes move by modularity gain, communities that fall apart are split into
    connected parts, parts become the nodes of a smaller graph, and so on while modularity rises.

    Ties go to the smaller label. A level ends when no node wants to move, or after ``rounds``: what is left to gain then
    falls to the next level. Parallel edges count with the sum of weights.
    """
    g = blocks.numbered(edges, "weight")
    return _communities(edges, gamma=gamma, rounds=rounds) if g is None else _labelled(g, "community", blocks.communities(g, gamma, rounds))


def _communities(edges: DataFrame, *, gamma: float = 1.0, rounds: int = 16) -> DataFrame:
    """Communities by joins."""
    one = edges.where("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").cast("double").alias("w"))
    g = settled(one.unionAll(one.select("b", "a", "w")).groupBy("a", "b").agg(F.sum("w").alias("w")))
    member = settled(g.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("community")))
    quality = None
    while True:
        label = _moved(g, gamma, rounds)
        inside = g.where("a <> b").join(label.toDF("a", "ca"), "a").join(label.toDF("b", "cb"), "b").where("ca = cb")
        part = components(inside.select(F.col("a").alias("src"), F.col("b").alias("dst")))
        part = settled(label.join(part, "node", "left").select("node", F.coalesce("component", "node").alias("part")))
        dropped(label)
        smaller = settled(g.join(part.toDF("a", "pa"), "a").join(part.toDF("b", "pb"), "b").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.sum("w").alias("w")))
        row = smaller.groupBy("a").agg(F.sum("w").alias("k"), F.sum(F.when(F.col("a") == F.col("b"), F.col("w"))).alias("inner")).agg(F.sum("k").alias("whole"), F.sum("inner").alias("inner"), F.sum(F.col("k") * F.col("k")).alias("squares")).first()
        if not row.whole:
            break
        now = (row.inner or 0.0) / row.whole - gamma * row.squares / row.whole**2
        if quality is not None and now <= quality + 1e-9:
            break
        quality = now
        joined = settled(member.join(part.toDF("community", "part"), "community").select("node", F.col("part").alias("community")))
        dropped(member, part, g)
        member, g = joined, smaller
    smallest = member.groupBy("community").agg(F.min("node").alias("name"))
    return member.join(smallest, "community").select("node", F.col("name").alias("community"))


def traverse(edges: DataFrame, start: list, *, depth: int = 2, direction: str = "both", types: list | None = None) -> DataFrame:
    """node, hops: nodes within ``depth`` steps of the start nodes, by fewest hops. direction: out, in or both."""
    e = edges.where(F.col("type").isin(types)) if types else edges
    out, back = e.select(F.col("src").alias("a"), F.col("dst").alias("b")), e.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    steps = {"out": out, "in": back, "both": out.union(back)}[direction].distinct()
    kind = edges.schema["src"].dataType.simpleString()
    seen = settled(edges.sparkSession.createDataFrame([(s, 0) for s in start], f"node {kind}, hops int"))
    front = seen
    for hop in range(1, depth + 1):
        front = settled(front.join(steps, front.node == steps.a).select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti").select("node", F.lit(hop).alias("hops")))
        seen = settled(seen.union(front))
    return seen


def degree_centrality(edges: DataFrame) -> DataFrame:
    pairs = undirected(edges)
    degree = pairs.groupBy(F.col("a").alias("node")).count()
    n = degree.agg(F.count("*").alias("n"))
    return degree.crossJoin(F.broadcast(n)).select("node", (F.col("count") / F.greatest(F.col("n") - 1, F.lit(1))).alias("centrality"))


def clustering(edges: DataFrame) -> DataFrame:
    """node, coefficient of nodes with two neighbours or more.

    Edges point to the end of higher degree (of ties, the larger), so a node of any degree has at most about the square
    root of twice the edges pointing out; each triangle is listed once, from its lowest node.
    """
    pairs = undirected(edges)
    degree = pairs.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("count"))
    rank = degree.select("node", F.struct("count", "node").alias("rank"))
    ranked = pairs.join(rank.toDF("a", "ra"), "a").join(rank.toDF("b", "rb"), "b").where("ra < rb")
    up = settled(ranked.select("a", "b", "rb"))
    wedge = up.toDF("x", "y", "ry").join(up.toDF("x", "z", "rz"), "x").where("ry < rz")
    closed = wedge.join(up.select(F.col("a").alias("y"), F.col("b").alias("z")), ["y", "z"]).select(F.explode(F.array("x", "y", "z")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))
    return degree.where("count > 1").join(closed, "node", "left").select("node", (2 * F.coalesce("triangles", F.lit(0)) / (F.col("count") * (F.col("count") - 1))).alias("coefficient"))


def analysis(edges: DataFrame) -> DataFrame:
    """node, centrality, core, component: of one numbering of the nodes."""
    g = blocks.numbered(edges)
    if g is None:
        return degree_centrality(edges).join(_k_core(edges), "node").join(_components(edges), "node")
    return _labelled(g, "component", blocks.components(g), centrality=g.degrees() / max(g.n - 1, 1), core=blocks.cores(g, _outside).astype(np.int64))


def importance(edges: DataFrame, *, error: float | None = None) -> DataFrame:
    """node, importance: 0.4 degree + 0.4 core + 0.2 betweenness (to ``error``), each over its maximum."""
    g = blocks.numbered(edges)
    score = None if g is None else _between(g, error)
    if score is None:
        parts = settled(degree_centrality(edges).join(k_core(edges), "node").join(_betweenness(edges, error=error), "node"))
    else:
        parts = g.named(centrality=g.degrees() / max(g.n - 1, 1), core=blocks.cores(g, _outside).astype(np.int64), score=score)
    if g is not None:
        g.drop()
    top = parts.agg(F.max("centrality").alias("d"), F.max("core").alias("c"), F.max("score").alias("b"))
    share = lambda x, y: F.when(F.col(y) > 0, F.col(x) / F.col(y)).otherwise(0.0)
    return parts.crossJoin(F.broadcast(top)).select("node", (0.4 * share("centrality", "d") + 0.4 * share("core", "c") + 0.2 * share("score", "b")).alias("importance"))
