"""Transitive closure by semi-naive rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import dropped, settled


def closure(edges: DataFrame, *, starts: DataFrame | None = None, least: int = 1, most: int | None = None) -> DataFrame:
    """a, b, hops: every b that some path of ``least`` to ``most`` edges (a, b) leads to from a, and the fewest hops.

    ``starts`` (a column a) are the nodes to begin at; None: all that have an edge. A round joins only the pairs that the
    last one found new, each with the edges of its end, and drops those known before; so a cycle ends when it brings
    nothing new, and rounds are as many as the longest of the shortest paths. With ``least`` 0, each start reaches itself.
    For ``least`` over 1 the paths of exactly that many edges come first; what then counts is the fewest hops from there.
    """
    edges = settled(edges.select("a", "b").where("a is not null and b is not null").distinct())
    begin = (starts.select("a") if starts is not None else edges.select("a")).where("a is not null").distinct()
    front = settled(begin.select("a", F.col("a").alias("b"), F.lit(0).alias("hops")))
    hop, seen = 0, [front]
    step = lambda pairs, hop: pairs.toDF("a", "via", "hops").join(edges.toDF("via", "b"), "via").select("a", "b", F.lit(hop).alias("hops")).distinct()
    while hop < least:
        hop += 1
        last, front = front, settled(step(front, hop))
        dropped(last)
        seen = [front]
    total = front
    while (most is None or hop < most) and not front.isEmpty():
        hop += 1
        new = settled(step(front, hop).join(total, ["a", "b"], "left_anti"))
        if new.isEmpty():
            dropped(new)
            break
        seen.append(new)
        front = new
        total = _union(seen)
        if len(seen) == 16:  # a union of many small tables is read again and again
            whole = settled(total)
            dropped(*seen[:-1])
            seen, total = [whole], whole
    dropped(edges)
    return total


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
