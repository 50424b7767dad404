"""Graphs as packed blocks of numbered nodes: a round of an algorithm is a scan of arrays instead of joins of rows.

Nodes get numbers in the order of their names. Node v is in block v % blocks; a row of the block table holds the
neighbours of all its nodes, one after the other. What is known of each node (a label, a degree: 4 to 8 bytes) is an array
that the driver sends to all tasks, each round anew; tasks send their nodes' new values back. So the driver and every
worker hold some 30 bytes a node and no edge; beyond ``MOST_NODES`` nodes callers go by tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .lineage import dropped, settled

MOST_NODES = 1 << 24
#: Entries of a graph that each worker holds whole, to search it from sources of its own.
MOST_SEARCHED = 100_000_000
#: Entries of a block, each edge being two, and edges dealt to blocks at a time.
ENTRIES, DEALT = 1 << 19, 1 << 20
_ROW = "block int, a binary, b binary, w binary"
_BLOCK = "block int, degrees binary, near binary, w binary"


def sums(x: np.ndarray, degrees: np.ndarray, how: np.ufunc = np.add) -> np.ndarray:
    """One value for each run of ``degrees`` entries of x; 0 for none."""
    out, full = np.zeros(len(degrees), x.dtype), degrees > 0
    if full.any():
        out[full] = how.reduceat(x, (np.cumsum(degrees) - degrees)[full])
    return out


def dealt(a: np.ndarray, b: np.ndarray, w: np.ndarray | None, blocks: int) -> pa.RecordBatch:
    """Entries as one row for each block of a."""
    place = a % blocks
    order = np.argsort(place, kind="stable")
    ends = np.cumsum(np.bincount(place, minlength=blocks))
    parts = [(k, at) for k, at in enumerate(np.split(order, ends[:-1])) if len(at)]
    columns = [[x[at].tobytes() if x is not None else None for _, at in parts] for x in (a, b, w)]
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), *[pa.array(c, pa.binary()) for c in columns]], names=["block", "a", "b", "w"])


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[list[np.ndarray]]:
    """Batches joined until they have so many rows, as arrays."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield [pa.chunked_array([b.column(i) for b in held]).to_numpy() for i in range(held[0].num_columns)]
            held, n = [], 0
    if n:
        yield [pa.chunked_array([b.column(i) for b in held]).to_numpy() for i in range(held[0].num_columns)]


def _joined(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


class Blocks:
    """``names``: node, id, or None if nodes have numbers only. ``table``: block, degrees, near, w (both directions)."""

    def __init__(self, spark: SparkSession, n: int, blocks: int, table: DataFrame | None, names: DataFrame | None = None, weighted: bool = False, own: tuple = ()):
        self.spark, self.n, self.blocks, self.table, self.names, self.weighted, self.own = spark, n, blocks, table, names, weighted, own

    @classmethod
    def built(cls, spark: SparkSession, entries: DataFrame, n: int, blocks: int, weighted: bool, names: DataFrame | None = None, own: tuple = ()) -> Blocks:
        """From dealt rows. Equal entries are one, with the sum of their weights."""

        def build(group: pa.Table) -> pa.Table:
            at = group.column("block")[0].as_py()
            key = (_joined(group.column("a"), np.int32).astype(np.int64) // blocks << 32) | _joined(group.column("b"), np.int32)
            w = None
            if weighted:
                order = np.argsort(key)
                key, w = key[order], _joined(group.column("w"), np.float64)[order]
                first = np.concatenate([[True], key[1:] != key[:-1]])
                w, key = np.add.reduceat(w, np.flatnonzero(first)).tobytes(), key[first]
            else:
                key = np.unique(key)
            degrees = np.bincount(key >> 32, minlength=-(-(n - at) // blocks)).astype(np.int32)
            near = (key & 0xFFFFFFFF).astype(np.int32)
            return pa.table([pa.array([at], pa.int32()), *[pa.array([x], pa.binary()) for x in (degrees.tobytes(), near.tobytes(), w)]], names=["block", "degrees", "near", "w"])

        table = settled(entries.repartition(blocks, "block").groupBy("block").applyInArrow(build, _BLOCK))
        return cls(spark, n, blocks, table, names, weighted, (*own, table))

    @property
    def context(self):
        return self.spark.sparkContext

    def gather(self, run: Callable, kinds: list, weights: bool = False) -> list[np.ndarray]:
        """Arrays over all nodes, of what ``run(block, degrees, near, w)`` gives for the nodes of each block."""
        blocks, names = self.blocks, [f"x{i}" for i in range(len(kinds))]

        def scan(batches):
            for batch in batches:
                for at, degrees, near, *w in zip(*[c.to_pylist() for c in batch.columns]):
                    got = run(at, np.frombuffer(degrees, np.int32), np.frombuffer(near, np.int32), np.frombuffer(w[0], np.float64) if w else None)
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), *[pa.array([x.astype(k).tobytes()], pa.binary()) for x, k in zip(got, kinds)]], names=["block", *names])

        out = [np.zeros(self.n, k) for k in kinds]
        if self.table is not None:
            columns = ["block", "degrees", "near"] + ["w"] * weights
            for row in self.table.select(*columns).mapInArrow(scan, ", ".join(["block int", *[f"{x} binary" for x in names]])).collect():
                for x, k, got in zip(out, kinds, row[1:]):
                    x[row[0] :: blocks] = np.frombuffer(got, k)
        return out

    def degrees(self) -> np.ndarray:
        return self.gather(lambda at, degrees, near, w: [degrees], [np.int32])[0]

    def pairs(self) -> DataFrame:
        """a, b: entries as rows of numbers."""
        blocks = self.blocks

        def rows(batches):
            for batch in batches:
                for at, degrees, near in zip(*[c.to_pylist() for c in batch.columns]):
                    degrees = np.frombuffer(degrees, np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(degrees)) * blocks + at, degrees), pa.int64()), pa.array(np.frombuffer(near, np.int32)).cast(pa.int64())], names=["a", "b"])

        return self.table.select("block", "degrees", "near").mapInArrow(rows, "a long, b long")

    def contracted(self, part: np.ndarray, n: int) -> Blocks:
        """The graph of parts (numbers below n): entries with the sum of weights, those inside a part as its loop."""
        held, blocks = self.context.broadcast(part), self.blocks
        fewer = max(1, min(blocks, n))

        def deal(batches):
            for batch in batches:
                for at, degrees, near, w in zip(*[c.to_pylist() for c in batch.columns]):
                    degrees = np.frombuffer(degrees, np.int32)
                    a = np.repeat(held.value[at::blocks], degrees)
                    key = a.astype(np.int64) << 32 | held.value[np.frombuffer(near, np.int32)]
                    order = np.argsort(key)
                    key = key[order]
                    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else []
                    if len(first):
                        key, w = key[first], np.add.reduceat(np.frombuffer(w, np.float64)[order], first)
                        yield dealt((key >> 32).astype(np.int32), (key & 0xFFFFFFFF).astype(np.int32), w, fewer)

        out = Blocks.built(self.spark, self.table.mapInArrow(deal, _ROW), n, fewer, True)
        held.destroy()
        return out

    def named(self, **values: np.ndarray) -> DataFrame:
        """node and, of each array, the node's value; settled."""
        held = self.context.broadcast(values)
        kinds = {np.dtype(np.int64): "long", np.dtype(np.int32): "int", np.dtype(np.float64): "double"}
        schema = ", ".join([f"node {self.names.schema['node'].dataType.simpleString()}", *[f"{k} {kinds[v.dtype]}" for k, v in values.items()]])

        def run(batches):
            for batch in batches:
                ids = batch.column("id").to_numpy()
                yield pa.RecordBatch.from_arrays([batch.column("node"), *[pa.array(v[ids]) for v in held.value.values()]], names=["node", *held.value])

        out = settled(self.names.select("node", "id").mapInArrow(run, schema))
        held.destroy()
        return out

    def drop(self) -> None:
        dropped(*self.own)


def numbered(edges: DataFrame, weight: str | None = None) -> Blocks | None:
    """The blocks of undirected ``edges`` (src, dst) without loops; None if they have over ``MOST_NODES`` nodes."""
    spark = edges.sparkSession
    ship(spark)
    one = settled(edges.where("src <> dst").select("src", "dst", *([F.col(weight).cast("double").alias("w")] if weight else [])))
    names = settled(one.select(F.explode(F.array("src", "dst")).alias("node")).distinct().sort("node").select("node", F.monotonically_increasing_id().alias("at")))
    sizes = {r.part: r.n for r in names.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n")).collect()}
    n = sum(sizes.values())
    if n > MOST_NODES:
        dropped(one, names)
        return None
    if not n:
        return Blocks(spark, 0, 1, None, names.select("node", F.lit(0).alias("id")), weight is not None, (one, names))
    before = np.cumsum([0, *[sizes.get(p, 0) for p in range(max(sizes))]]).tolist()
    number = F.array(*[F.lit(b) for b in before])[F.shiftright("at", 33).cast("int")] + F.col("at").bitwiseAND((1 << 33) - 1)
    names_ = names.select("node", number.cast("int").alias("id"))
    for seed in count():
        known = names_.select("id", F.xxhash64("node", F.lit(seed)).alias("h")).mapInArrow(_packed, "ids binary, h binary").collect()
        ids, hashes = np.concatenate([np.frombuffer(r.ids, np.int32) for r in known]), np.concatenate([np.frombuffer(r.h, np.int64) for r in known])
        order = np.argsort(hashes)
        ids, hashes = ids[order], hashes[order]
        if not (hashes[1:] == hashes[:-1]).any():
            break
    held = spark.sparkContext.broadcast((hashes, ids))
    blocks = max(1, min(n, -(-2 * one.count() // ENTRIES)))

    def deal(batches):
        hashes, ids = held.value
        for a, b, *w in gathered(batches, DEALT):
            a, b = ids[np.searchsorted(hashes, a)], ids[np.searchsorted(hashes, b)]
            yield dealt(np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w[0], w[0]]) if w else None, blocks)

    hashed = one.select(F.xxhash64("src", F.lit(seed)).alias("a"), F.xxhash64("dst", F.lit(seed)).alias("b"), *(["w"] if weight else []))
    out = Blocks.built(spark, hashed.mapInArrow(deal, _ROW), n, blocks, weight is not None, names_, (names,))
    held.destroy()
    dropped(one)
    return out


def _packed(batches):
    for ids, hashes in gathered(batches, DEALT):
        yield pa.RecordBatch.from_arrays([pa.array([ids.astype(np.int32).tobytes()], pa.binary()), pa.array([hashes.astype(np.int64).tobytes()], pa.binary())], names=["ids", "h"])


def components(g: Blocks, same: np.ndarray | None = None) -> np.ndarray:
    """The smallest node that each reaches; with ``same``, over edges whose ends have the same value there.

    A round takes the least label beside each node; its tree then hangs on that label's, and paths are halved until all
    hang on roots.
    """
    label, blocks = np.arange(g.n, dtype=np.int32), g.blocks
    while g.n:
        held = g.context.broadcast((label, same))

        def run(at, degrees, near, w):
            label, same = held.value
            theirs = label[near]
            if same is not None:
                theirs = np.where(same[near] == np.repeat(same[at::blocks], degrees), theirs, np.repeat(label[at::blocks], degrees))
            return [np.where(degrees > 0, np.minimum(sums(theirs, degrees, np.minimum), label[at::blocks]), label[at::blocks])]

        (least,) = g.gather(run, [np.int32])
        held.destroy()
        lower = np.flatnonzero(least < label)
        if not len(lower):
            break
        parent = np.arange(g.n, dtype=np.int32)
        np.minimum.at(parent, label[lower], least[lower])
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        label = parent[label]
    return label


def h_index(core: np.ndarray, own: np.ndarray, degrees: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Of each node the largest h, its own value at most, such that h neighbours have h or more."""
    theirs = core[near]
    lacking = sums((theirs >= np.repeat(own, degrees)).astype(np.int32), degrees) < own
    out = own.copy()
    if lacking.any():
        few, of = degrees[lacking], np.repeat(lacking, degrees)
        row = np.repeat(np.arange(len(few)), few)
        key = np.sort((row << 32) | (np.int64(1 << 31) - np.minimum(theirs[of], own[lacking][row])))
        rank = np.arange(len(key)) - np.repeat(np.cumsum(few) - few, few)
        out[lacking] = sums(((1 << 31) - (key & 0xFFFFFFFF) > rank).astype(np.int32), few)
    return out


def cores(g: Blocks, outside: Callable[[DataFrame], np.ndarray] | None = None, rounds: int = 32) -> np.ndarray:
    """Core numbers: degrees, then of each node the h-index of its neighbours until nothing changes.

    Trees and chains would take as many rounds as they are long. So after ``rounds`` of them ``outside`` tells, from the
    pairs, which nodes are outside the 2-core; they have 1.
    """
    core, blocks = g.degrees(), g.blocks
    for r in count():
        if r == rounds and outside is not None:
            core[outside(g.pairs())] = 1
        held = g.context.broadcast(core)
        (new,) = g.gather(lambda at, degrees, near, w: [h_index(held.value, held.value[at::blocks], degrees, near)], [np.int32]) if g.n else (core,)  # noqa: B023
        held.destroy()
        if (new == core).all():
            return core
        core = new


def _turn(n: int, r: int) -> np.ndarray:
    """A half of the nodes, another one each round: bits of a mixed number."""
    x = np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((r + 1) * 0xD1342543DE82EF95 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(63)).astype(bool)


def best_moves(at: int, blocks: int, degrees, near, w, label, total, degree, whole: float, gamma: float) -> tuple[np.ndarray, np.ndarray]:
    """For the nodes of a block the label of the highest gain (ties: the smaller one), and whether it beats their own."""
    ids = np.arange(len(degrees), dtype=np.int64) * blocks + at
    row = np.repeat(np.arange(len(degrees), dtype=np.int64), degrees)
    tie = near != ids[row]
    own, k = label[ids], degree[ids]
    key = np.concatenate([row[tie] << 32 | label[near[tie]], np.arange(len(ids)) << 32 | own])
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    weight = np.add.reduceat(np.concatenate([w[tie], np.zeros(len(ids))])[order], first)
    row, c = key[first] >> 32, key[first] & 0xFFFFFFFF
    here = c == own[row]
    gain = np.round(weight - gamma * k[row] * (total[c] - np.where(here, k[row], 0.0)) / whole, 9)
    most = sums(gain, np.bincount(row, minlength=len(ids)), np.maximum)
    top = np.flatnonzero(gain == most[row])
    top = top[np.concatenate([[True], row[top[1:]] != row[top[:-1]]])]
    return c[top], most > gain[here]


def moved(g: Blocks, degree: np.ndarray, gamma: float, rounds: int) -> np.ndarray:
    """Labels after moves by modularity gain: half of the nodes, another half each time, may move in a round."""
    label, blocks, whole = np.arange(g.n, dtype=np.int32), g.blocks, float(degree.sum()) or 1.0
    for r in range(rounds):
        held = g.context.broadcast((label, np.bincount(label, degree, g.n), degree))
        best, wants = g.gather(lambda at, degrees, near, w: best_moves(at, blocks, degrees, near, w, *held.value, whole, gamma), [np.int32, np.int8], weights=True)  # noqa: B023
        held.destroy()
        wants = wants.astype(bool)
        label = np.where(wants & _turn(g.n, r), best, label)
        if not wants.any():
            break
    return label


def communities(g: Blocks, gamma: float, rounds: int) -> np.ndarray:
    """Of each node its community's smallest node, level by level while modularity rises."""
    member, quality, level = np.arange(g.n, dtype=np.int32), None, g
    while g.n:
        blocks = level.blocks

        def ends(at, degrees, near, w):
            loop = near == np.repeat(np.arange(len(degrees)) * blocks + at, degrees)  # noqa: B023
            return [sums(w, degrees), sums(np.where(loop, w, 0.0), degrees)]

        degree, inner = level.gather(ends, [np.float64, np.float64], weights=True)
        whole = degree.sum()
        if level is not g:
            now = inner.sum() / whole - gamma * (degree**2).sum() / whole**2
            if quality is not None and now <= quality + 1e-9:
                level.drop()
                break
            quality, member = now, part[member]  # noqa: F821
        if not whole:
            break
        roots, part = np.unique(components(level, moved(level, degree, gamma, rounds)), return_inverse=True)
        part = part.astype(np.int32)
        smaller = level.contracted(part, len(roots))
        if level is not g:
            level.drop()
        level = smaller
    _, first, of = np.unique(member, return_index=True, return_inverse=True)
    return first[of].astype(np.int32)


def _edges(start: np.ndarray, degree: np.ndarray, near: np.ndarray, nodes: np.ndarray, most: int = 1 << 21) -> Iterator[tuple]:
    """Slices of the nodes with their degrees and all their neighbours, some ``most`` at a time."""
    d = degree[nodes].astype(np.int64)
    ends, lo = np.cumsum(d), 0
    while lo < len(nodes):
        done = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + most, "right")))
        some = d[lo:hi]
        at = np.arange(ends[hi - 1] - done) + np.repeat(start[nodes[lo:hi]] - (np.cumsum(some) - some), some)
        yield lo, hi, some, near[at]
        lo = hi


def _added(index: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct indices and the sum of the weights of each."""
    if len(index) > n // 16:
        return (at := np.flatnonzero(total := np.bincount(index, weight, n))), total[at]
    at, of = np.unique(index, return_inverse=True)
    return at, np.bincount(of, weight, len(at))


def dependencies(start: np.ndarray, degree: np.ndarray, near: np.ndarray, source: int) -> np.ndarray:
    """Of each node the sum of shares of shortest paths from the source that pass it, level by level there and back.

    A level is found from the last one or from the nodes not yet seen, whichever have fewer edges; so on the way back.
    """
    n = len(degree)
    far, paths, levels = np.full(n, -1, np.int32), np.zeros(n), [np.array([source])]
    far[source], paths[source] = 0, 1.0
    left = int(degree.sum(dtype=np.int64)) - int(degree[source])
    while True:
        last, k = levels[-1], len(levels) - 1
        found, weight = [], []
        if int(degree[last].sum(dtype=np.int64)) > left + n // 8:
            unseen = np.flatnonzero(far < 0)
            for lo, hi, some, nb in _edges(start, degree, near, unseen):
                got = sums(np.where(far[nb] == k, paths[nb], 0.0), some)
                found.append(unseen[lo:hi][got > 0])
                weight.append(got[got > 0])
        else:
            for lo, hi, some, nb in _edges(start, degree, near, last):
                new = far[nb] < 0
                at, got = _added(nb[new], np.repeat(paths[last[lo:hi]], some)[new], n)
                found.append(at)
                weight.append(got)
        at, got = _added(np.concatenate(found), np.concatenate(weight), n) if found else (last[:0], None)
        if not len(at):
            break
        far[at], paths[at] = k + 1, got
        left -= int(degree[at].sum(dtype=np.int64))
        levels.append(at)
    owed, share = np.zeros(n), np.zeros(n)
    for k in range(len(levels) - 2, 0, -1):
        here, beyond = levels[k], levels[k + 1]
        share[beyond] = (1 + owed[beyond]) / paths[beyond]
        if degree[here].sum(dtype=np.int64) <= degree[beyond].sum(dtype=np.int64):
            for lo, hi, some, nb in _edges(start, degree, near, here):
                owed[here[lo:hi]] = sums(np.where(far[nb] == k + 1, share[nb], 0.0), some)
        else:
            for lo, hi, some, nb in _edges(start, degree, near, beyond):
                back = far[nb] == k
                at, got = _added(nb[back], np.repeat(share[beyond[lo:hi]], some)[back], n)
                owed[at] += got
        owed[here] *= paths[here]
    return owed


def owed(g: Blocks, sources: np.ndarray, entries: int) -> np.ndarray:
    """The sum of ``dependencies`` over the sources. Every task holds the whole graph and searches from its share of them."""
    pieces, held, size = [], [], 0
    for row in g.table.select("block", "degrees", "near").toLocalIterator(prefetchPartitions=True):
        held.append((row[0], bytes(row[1]), bytes(row[2])))
        size += len(row[1]) + len(row[2])
        if size > 16 << 20:
            pieces.append(g.context.broadcast(held))
            held, size = [], 0
    pieces.append(g.context.broadcast(held))
    n, blocks, slice_ = g.n, g.blocks, 1 << 17
    tasks = max(1, min(-(-len(sources) // 4), 6 * g.context.defaultParallelism))

    def search(batches):
        start, degree, near, at = np.zeros(n, np.int64), np.zeros(n, np.int32), np.zeros(entries, np.int32), 0
        for piece in pieces:
            for block, degrees, part in piece.value:
                d, part = np.frombuffer(degrees, np.int32), np.frombuffer(part, np.int32)
                degree[block::blocks], start[block::blocks] = d, np.cumsum(d, dtype=np.int64) - d + at
                near[at : at + len(part)] = part
                at += len(part)
            vars(piece).pop("_value", None)  # only one copy of the graph stays
        total = np.zeros(n)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                total += dependencies(start, degree, near, int(sources[k]))
        for lo in range(0, n, slice_):
            yield pa.RecordBatch.from_arrays([pa.array([lo // slice_], pa.int32()), pa.array([total[lo : lo + slice_].tobytes()], pa.binary())], names=["slice", "owed"])

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.float64) for x in group.column("owed").to_pylist())
        return pa.table([group.column("slice").slice(0, 1), pa.array([total.tobytes()], pa.binary())], names=["slice", "owed"])

    found = g.spark.range(0, len(sources), 1, tasks).mapInArrow(search, "slice int, owed binary").groupBy("slice").applyInArrow(add, "slice int, owed binary")
    out = np.zeros(n)
    for row in found.collect():
        out[row[0] * slice_ : (row[0] + 1) * slice_] = np.frombuffer(row[1], np.float64)
    for piece in pieces:
        piece.destroy()
    return out
