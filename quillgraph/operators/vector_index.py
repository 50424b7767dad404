"""An inverted-list index over vectors, in Parquet, and the exact nearest-neighbour join that its bounds make cheap.

Centroids are fitted on a bounded sample (``SAMPLE_ROWS``, those of the smallest hashes of their ids); every vector goes to
the list of its nearest centroid, and lists are the partitions of the table, so a search reads the files of the lists it
probes and no others. Each list keeps the range of angles between its vectors and its centroid: by the triangle
inequality a list can be skipped for a query whose k nearest so far are all closer than that range allows. So besides
the usual search of some lists there is an exact one, which reads on only where the bound can't rule a list out.

Vectors count by direction. Null vectors and those of another length are left out, as are their entries if null; a zero
vector has similarity 0 to all. Ties go to smaller ids. The driver holds centroids, the sample and one row per list.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .lineage import dropped, settled

SAMPLE_ROWS, MOST_LISTS, ROUNDS = 20_000, 1024, 8
#: Vectors of one block: a product of two blocks is the work of one task at a time.
BLOCK = 2000
#: Vectors of a tile of the nearest-neighbour join, and those of its rows that are multiplied at a time.
TILE, TILE_ROWS = 16_384, 256
#: What rounding may take from an angle.
SLACK = 1e-6


def unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def fit_centroids(vectors: DataFrame, lists: int, sample_rows: int = SAMPLE_ROWS, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of a sample of ``vectors`` (id, v), by k-means on directions; fewer than ``lists`` if it has fewer."""
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("v").collect()
    sample = np.unique(unit(np.array([r.v for r in rows], float)), axis=0) if rows else np.zeros((0, 0))
    order = np.random.default_rng(11).permutation(len(sample))
    centres = sample[order[:lists]]
    for _ in range(rounds):
        if len(centres) < 2:
            break
        near = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        moved = unit(sums)
        gone = ~np.bincount(near, minlength=len(centres)).astype(bool)
        moved[gone] = centres[gone]
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres


def _clean(vectors: DataFrame, id_col: str, vector_col: str, type_col: str | None, dims: int) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    kind = F.col(type_col).cast("string") if type_col else F.lit(None).cast("string")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), kind.alias("type"))
    return rows.where(F.col("v").isNotNull() & (F.size("v") == dims) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)))


def _assigned(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """``rows`` (id, v, type) with unit vectors, the list of each and its angle there."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                m = unit(np.stack(frame["v"].to_numpy()).astype(float))
                cosine = m @ centres.T
                at = cosine.argmax(1)
                yield pd.DataFrame({"id": frame["id"], "v": list(m), "type": frame["type"], "list": at.astype(np.int32), "angle": angle(cosine[np.arange(len(m)), at])})

    return rows.mapInPandas(run, "id long, v array<double>, type string, list int, angle double")


def _ranges(rows: DataFrame) -> pd.DataFrame:
    """One row per list: its size and its least and largest angle."""
    return rows.groupBy("list").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).toPandas()


def bounds(vectors: np.ndarray, centres: np.ndarray, lists: pd.DataFrame) -> np.ndarray:
    """The highest cosine that a vector of each list (columns) can have with each of the unit ``vectors`` (rows)."""
    to_centre = angle(vectors @ centres[lists["list"].to_numpy()].T)
    apart = np.maximum(0.0, np.maximum(lists["low"].to_numpy() - to_centre, to_centre - lists["high"].to_numpy()))
    best = np.cos(np.clip(apart - SLACK, 0.0, math.pi))
    best[np.linalg.norm(vectors, axis=1) == 0] = 0.0
    return best


def _top(ids: np.ndarray, near: np.ndarray, similarity: np.ndarray, k: int) -> pd.DataFrame:
    """The k best of each row of a matrix of similarities, ties to smaller ids (``near`` ascends)."""
    most = min(k, similarity.shape[1])
    if not most:
        return pd.DataFrame({"query": ids[:0], "id": near[:0], "similarity": np.zeros(0)})
    best = np.argsort(-similarity, axis=1, kind="stable")[:, :most]
    rows = np.repeat(np.arange(len(ids)), most)
    return pd.DataFrame({"query": ids[rows], "id": near[best.ravel()], "similarity": similarity[rows, best.ravel()]})


def _met(queries: DataFrame, rows: DataFrame, k: int, sizes: dict[int, int], id_type: str = "long") -> DataFrame:
    """query, id, similarity: for each query (query, v, list) the k best rows of that list, of each block of it."""
    blocks = F.create_map(*[x for at, n in sizes.items() for x in (F.lit(at), F.lit(-(-n // BLOCK)))]) if sizes else None
    if blocks is None:
        return rows.sparkSession.createDataFrame([], "query long, id long, similarity double")
    many = F.element_at(blocks, F.col("list"))
    left = queries.withColumn("block", F.explode(F.sequence(F.lit(0), many - 1)))
    right = rows.withColumn("block", F.pmod(F.xxhash64("id"), many).cast("int"))

    def product(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"query": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "similarity": np.zeros(0)})
        b = b.sort_values("id")
        m, near, out = np.stack(b["v"].to_numpy()), b["id"].to_numpy(), []
        for at in range(0, len(a), BLOCK):
            part = a.iloc[at : at + BLOCK]
            out.append(_top(part["query"].to_numpy(), near, np.stack(part["v"].to_numpy()) @ m.T, k))
        return pd.concat(out)

    return left.groupBy("list", "block").cogroup(right.groupBy("list", "block")).applyInPandas(product, "query long, id long, similarity double")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, whatever the number of lists they come from; ties to smaller ids."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("loss"), "id")))
    return found.groupBy("query").agg(F.slice(order, 1, k).alias("best")).select("query", F.inline("best")).select("query", "id", (-F.col("loss")).alias("similarity"))


class VectorIndex:
    """An index in a folder: ``vectors`` partitioned by list, and ``lists`` with centroids as JSON text."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        ship(spark)
        head = json.loads("".join(r.value for r in spark.read.text(f"{self.path}/lists").orderBy("value").collect()) or "[]")
        self.centres = np.array(head, float)
        self.dims = self.centres.shape[1] if self.centres.ndim == 2 else 0

    @classmethod
    def build(cls, vectors: DataFrame, path: str, *, lists: int | None = None, sample_rows: int = SAMPLE_ROWS, id_col: str = "vec_id", vector_col: str = "v", type_col: str | None = "label") -> VectorIndex:
        """Fits centroids, about as many as the square root of the rows, and writes all vectors to their lists."""
        spark = vectors.sparkSession
        ship(spark)
        sizes = vectors.where(F.col(vector_col).isNotNull()).groupBy(F.size(vector_col).alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()
        dims = sizes[0].dims if sizes else 0
        rows = _clean(vectors, id_col, vector_col, type_col, dims)
        wanted = lists or max(1, min(MOST_LISTS, round(math.sqrt(sizes[0]["count"])))) if sizes else 1
        centres = fit_centroids(rows, wanted, sample_rows)
        spark.createDataFrame([(json.dumps(centres.tolist()),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/lists")
        if len(centres):
            _assigned(rows, centres).repartition("list").write.mode("overwrite").partitionBy("list").parquet(f"{path}/vectors")
        return cls(spark, path)

    def rows(self) -> DataFrame:
        """id, v (unit), type, angle, list of all vectors."""
        schema = "id long, v array<double>, type string, angle double, list int"
        return self.spark.read.schema(schema).parquet(f"{self.path}/vectors") if len(self.centres) else self.spark.createDataFrame([], schema)

    def append(self, vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "v", type_col: str | None = "label") -> None:
        """Adds vectors to the lists there are; rebuild when they no longer fit the data."""
        _assigned(_clean(vectors, id_col, vector_col, type_col, self.dims), self.centres).repartition("list").write.mode("append").partitionBy("list").parquet(f"{self.path}/vectors")

    def rebuild(self, path: str, *, lists: int | None = None) -> VectorIndex:
        """The same vectors in a new folder, with centroids fitted to all of them."""
        return VectorIndex.build(self.rows(), path, lists=lists, id_col="id", vector_col="v", type_col="type")

    def _queries(self, queries: DataFrame, id_col: str, vector_col: str) -> DataFrame:
        centres = self.centres

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if len(frame):
                    yield pd.DataFrame({"query": frame["id"], "v": list(unit(np.stack(frame["v"].to_numpy()).astype(float)))})

        ship(self.spark)
        return settled(_clean(queries, id_col, vector_col, None, centres.shape[1] if len(centres) else 0).mapInPandas(run, "query long, v array<double>"))

    def search(self, queries: DataFrame, k: int = 10, *, probes: int | None = 8, types: list | None = None, id_col: str = "vec_id", vector_col: str = "v") -> DataFrame:
        """query, id, similarity: the k nearest in the ``probes`` nearest lists of each query; with None, of all vectors.

        Types are filtered before the cut. The exact search probes the nearest list of each query first, and then only
        those lists that its bound can't rule out.
        """
        rows = self.rows()
        rows = rows.where(F.col("type").isin([str(t) for t in types])) if types is not None else rows
        asked, lists = self._queries(queries, id_col, vector_col), _ranges(rows)
        first = self._dealt(asked, lists, 1 if probes is None else probes, None)
        found = settled(_best(self._read(rows, first, lists, k), k))
        if probes is None:
            reached = asked.join(found.groupBy("query").agg(F.count("*").alias("n"), F.min("similarity").alias("least")), "query", "left").select("query", "v", F.when(F.col("n") >= k, F.col("least")).otherwise(-2.0).alias("least"))
            more = self._dealt(settled(reached), lists, None, first)
            found = _best(found.unionByName(self._read(rows, more, lists, k)), k)
        return found

    def _dealt(self, queries: DataFrame, lists: pd.DataFrame, probes: int | None, but: DataFrame | None) -> DataFrame:
        """query, v, list: the nearest ``probes`` lists of each query, or, with ``least``, all that may hold something as close."""
        centres = self.centres

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if not len(frame) or not len(lists):
                    continue
                m = np.stack(frame["v"].to_numpy())
                if probes is None:
                    row, at = np.nonzero(bounds(m, centres, lists) >= frame["least"].to_numpy()[:, None])
                else:
                    near = np.argsort(-(m @ centres[lists["list"].to_numpy()].T), axis=1, kind="stable")[:, :probes]
                    row, at = np.repeat(np.arange(len(m)), near.shape[1]), near.ravel()
                yield pd.DataFrame({"query": frame["query"].to_numpy()[row], "v": list(m[row]), "list": lists["list"].to_numpy()[at]})

        dealt = queries.mapInPandas(run, "query long, v array<double>, list int")
        return settled(dealt.join(but.select("query", "list"), ["query", "list"], "left_anti") if but is not None else dealt)

    def _read(self, rows: DataFrame, dealt: DataFrame, lists: pd.DataFrame, k: int) -> DataFrame:
        """What the dealt queries find; only the files of their lists are read."""
        wanted = sorted(r["list"] for r in dealt.select("list").distinct().collect())
        sizes = dict(zip(lists["list"].tolist(), lists["n"].tolist()))
        return _met(dealt, rows.where(F.col("list").isin(wanted)), k, {at: sizes[at] for at in wanted})


def _of(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, vectors, lists and least similarities of a packed tile."""
    ids, at, least = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["lists"], np.int32), np.frombuffer(row["least"], np.float64)
    return ids, np.frombuffer(row["v"], np.float64).reshape(len(ids), -1), at, least


def _above(ids: np.ndarray, near: np.ndarray, s: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query, id, similarity of the k best of each row that reach ``least``, ties to smaller ids."""
    row, col = np.nonzero(s >= least[:, None])
    value = s[row, col]
    order = np.lexsort((near[col], -value, row))
    row, col, value = row[order], col[order], value[order]
    first = np.searchsorted(row, np.arange(len(ids)))
    few = np.arange(len(row)) - first[row] < k
    return ids[row[few]], near[col[few]], value[few]


def _met_tile(mine: tuple, other: tuple, wanted: np.ndarray, ranges: pd.DataFrame, k: int, skip_own: bool) -> tuple[list, int]:
    """What the rows of one tile find in the lists of another that ``wanted`` (rows x lists of ``ranges``) names."""
    ids, v, own, least = mine
    near, m, lists, _ = other
    place = np.searchsorted(ranges["list"].to_numpy(), lists)
    ends = np.flatnonzero(np.concatenate([own[1:] != own[:-1], [True]])) + 1
    out, n = [], 0
    for lo, hi in ((at, min(end, at + TILE_ROWS)) for start, end in zip([0, *ends[:-1]], ends) for at in range(start, end, TILE_ROWS)):
        ask = wanted[lo:hi]
        any_ = np.flatnonzero(np.isin(np.arange(ask.shape[1]), place) & ask.any(0))
        if skip_own:
            any_ = any_[ranges["list"].to_numpy()[any_] != own[lo]]
        if not len(any_):
            continue
        # All rows with all lists that some want, or, where few want each, list by list.
        groups = [(np.arange(hi - lo), np.isin(place, any_))] if ask[:, any_].mean() >= 0.5 else [(np.flatnonzero(ask[:, x]), place == x) for x in any_]
        for rows, columns in groups:
            s = v[lo + rows] @ m[columns].T
            n += s.size
            out.append(_above(ids[lo + rows], near[columns], s, least[lo + rows], k))
    return out, n


def _reach(v: np.ndarray, least: np.ndarray, centres: np.ndarray, ranges: pd.DataFrame) -> np.ndarray:
    return np.concatenate([bounds(v[lo : lo + TILE_ROWS], centres, ranges) >= least[lo : lo + TILE_ROWS, None] for lo in range(0, len(v), TILE_ROWS)])


def _near_tiles(classes: DataFrame, centres: np.ndarray, ranges: pd.DataFrame, k: int) -> tuple[DataFrame, DataFrame, int]:
    """Tiles; query, id, similarity with the k + 1 best of every class, itself among them; how many pairs were compared."""
    spark = classes.sparkSession
    ranges = ranges.sort_values("list").reset_index(drop=True)
    first, parts, tile, filled = [0] * len(centres), [1] * len(centres), 0, 0
    for at, n in zip(ranges["list"].tolist(), ranges["n"].tolist()):
        if filled and filled + n > TILE:
            tile, filled = tile + 1, 0
        first[at], parts[at] = tile, max(1, -(-n // TILE))
        tile, filled = tile + parts[at] - 1, filled + n if parts[at] == 1 else TILE
    spread = F.array(*map(F.lit, parts))[F.col("list")]
    dealt = classes.select("id", "v", "list", (F.array(*map(F.lit, first))[F.col("list")] + F.pmod(F.xxhash64("id"), spread).cast("int")).alias("tile"))
    # Tiles that each list lies in: a row that may find something in a list asks all of them.
    tiles_of = [range(first[at], first[at] + parts[at]) for at in ranges["list"].tolist()]

    def home(group: pa.Table) -> pa.Table:
        ids, lists = group.column("id").to_numpy(), group.column("list").to_numpy()
        order = np.lexsort((ids, lists))
        v = np.concatenate([c.flatten().to_numpy() for c in group.column("v").chunks]).reshape(len(ids), -1)[order]
        ids, lists, mine = ids[order], lists[order], group.column("tile")[0].as_py()
        least, found, n = np.full(len(ids), -2.0), [], 0
        ends = np.flatnonzero(np.concatenate([lists[1:] != lists[:-1], [True]])) + 1
        for lo, hi in zip([0, *ends[:-1]], ends):
            for at in range(lo, hi, TILE_ROWS):
                part = slice(at, min(hi, at + TILE_ROWS))
                s = v[part] @ v[lo:hi].T
                n += s.size
                cut = np.full(len(s), -2.0)
                if hi - lo > k + 1:
                    cut = np.partition(s, hi - lo - k - 1, axis=1)[:, hi - lo - k - 1]
                found.append(_above(ids[part], ids[lo:hi], s, cut, k + 1))
                if hi - lo > k:
                    s[np.arange(len(s)), np.arange(part.start - lo, part.stop - lo)] = -2.0
                    least[part] = np.partition(s, hi - lo - k, axis=1)[:, hi - lo - k]
        me = (ids, v, lists, least)
        wanted = _reach(v, least, centres, ranges)
        more, m = _met_tile(me, me, wanted, ranges, k + 1, True)
        asked = sorted({t for x in np.flatnonzero(wanted.any(0)) for t in tiles_of[x]} - {mine})
        q, near, s = (np.concatenate(x) for x in zip(*found, *more))
        values = {"tile": mine, "ids": ids.tobytes(), "v": v.tobytes(), "lists": lists.astype(np.int32).tobytes(), "least": least.tobytes(), "asks": asked, "n": n + m, "q": q.tobytes(), "near": near.tobytes(), "s": s.tobytes()}
        return pa.Table.from_pylist([values], schema=kinds)

    binary = ["ids", "v", "lists", "least", "q", "near", "s"]
    kinds = pa.schema([("tile", pa.int32()), *[(c, pa.binary()) for c in binary[:4]], ("asks", pa.list_(pa.int32())), ("n", pa.int64()), *[(c, pa.binary()) for c in binary[4:]]])
    tiles = settled(dealt.repartition(tile + 1, "tile").groupBy("tile").applyInArrow(home, "tile int, ids binary, v binary, lists binary, least binary, asks array<int>, n long, q binary, near binary, s binary"))

    def rows(batches):
        for batch in batches:
            for q, near, s in zip(*[c.to_pylist() for c in batch.columns]):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(q, np.int64)), pa.array(np.frombuffer(near, np.int64)), pa.array(np.frombuffer(s, np.float64))], names=["query", "id", "similarity"])

    def meet(group: pa.Table) -> pa.Table:
        pair = [_of(r) for r in group.sort_by("tile").to_pylist()]
        found, n = [], 0
        for mine, other in (pair, pair[::-1]):
            got, m = _met_tile(mine, other, _reach(mine[1], mine[3], centres, ranges), ranges, k + 1, False)
            found, n = found + got, n + m
        q, near, s = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"n": pa.array([n], pa.int64()), "q": pa.array([q.tobytes()], pa.binary()), "near": pa.array([near.tobytes()], pa.binary()), "s": pa.array([s.tobytes()], pa.binary())})

    asks = tiles.select("tile", "asks", "n").collect()
    pairs = sorted({(min(r.tile, t), max(r.tile, t)) for r in asks for t in r.asks})
    shape, compared = "query long, id long, similarity double", sum(r.n for r in asks)
    found = tiles.select("q", "near", "s").mapInArrow(rows, shape)
    if pairs:
        both = spark.createDataFrame([(p, t) for p, two in enumerate(pairs) for t in two], "pair int, tile int")
        met = settled(tiles.select("tile", "ids", "v", "lists", "least").join(F.broadcast(both), "tile").repartition(min(len(pairs), 2000), "pair").groupBy("pair").applyInArrow(meet, "n long, q binary, near binary, s binary"))
        compared += met.agg(F.sum("n")).first()[0]
        found = settled(found.unionByName(met.select("q", "near", "s").mapInArrow(rows, shape)))
        dropped(met)
    return tiles, found, compared


def nearest_join(vectors: DataFrame, k: int = 10, *, lists: int | None = None, sample_rows: int = SAMPLE_ROWS, id_col: str = "vec_id", vector_col: str = "v") -> tuple[DataFrame, int]:
    """query, id, similarity: the exact k nearest other vectors of every vector; and how many pairs were compared.

    Equal vectors are one class with its smallest ids, so copies cost nothing. A class is compared with its own list
    first; the similarity of its k-th best there then rules out every list whose bound is lower. Classes lie in tiles of
    some ``TILE`` vectors, of whole lists or parts of one; a task holds two tiles at most.
    """
    spark = vectors.sparkSession
    ship(spark)
    sizes = vectors.where(F.col(vector_col).isNotNull()).groupBy(F.size(vector_col).alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query long, id long, similarity double"), 0
    rows = _clean(vectors, id_col, vector_col, None, sizes[0].dims)
    wanted = lists or max(1, min(MOST_LISTS, round(math.sqrt(sizes[0]["count"]))))
    centres = fit_centroids(rows, wanted, sample_rows)
    placed = settled(_assigned(rows, centres).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(max(1, sizes[0]["count"] // 1000)))))
    # Of each class the k + 1 smallest ids: of each salt first, then of those.
    few = lambda c: F.slice(F.array_sort(F.array_distinct(F.collect_list(c))), 1, k + 1)
    salted = placed.groupBy("v", "list", "angle", "salt").agg(few("id").alias("ids"))
    classes = salted.groupBy("v", "list").agg(F.min("angle").alias("angle"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))
    classes = settled(classes.select(F.col("ids")[0].alias("id"), "v", "list", "angle", "ids"))
    ranges = _ranges(classes)
    tiles, found, compared = _near_tiles(classes, centres, ranges, k)
    near = settled(_best(found, k + 1))
    ids = near.join(classes.select("id", "ids"), "id").select("query", "similarity", F.explode("ids").alias("id"))
    choice = settled(_best(ids, k + 1).groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("loss"), "id"))).alias("best")))
    member = placed.join(classes.select("v", F.col("id").alias("query")), "v").select("id", "query")
    out = member.withColumnRenamed("id", "me").join(choice, "query").select("me", F.slice(F.filter("best", lambda b: b.id != F.col("me")), 1, k).alias("best")).distinct().select("me", F.inline("best"))
    out = settled(out.select(F.col("me").alias("query"), "id", (-F.col("loss")).alias("similarity")))
    dropped(placed, classes, tiles, found, near, choice)
    return out, int(compared)
