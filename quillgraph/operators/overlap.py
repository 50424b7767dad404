"""Pairs of sets that share enough members, by a prefix filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import settled

#: Ids of a slice: a row of pairs to make is two slices.
SLICE = 256


def candidates(members: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b), a < b, that may share ``least`` members, and the sets (id, set) themselves. ``members``: id, m.

    A set enters the buckets of all its members but its ``least`` - 1 most frequent ones: two sets that share ``least``
    meet in one of those that are left to both. So a member that all sets have brings no pairs together.
    """
    once = settled(members.select("id", "m").where("id is not null and m is not null").distinct())
    often = once.groupBy("m").agg(F.count("*").alias("n"))
    ordered = once.join(often, "m").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "m"))).alias("by")).where(F.size("by") >= least)
    sets = settled(ordered.select("id", F.transform("by", lambda x: x.m).alias("set")))
    entry = sets.select("id", F.explode(F.slice("set", F.lit(1), F.size("set") - least + 1)).alias("m"))
    pairs = entry.toDF("a", "m").join(entry.toDF("b", "m"), "m").where("a < b").select("a", "b").distinct()
    return pairs, sets


def overlapping(members: DataFrame, least: int) -> DataFrame:
    """xs, ys, within, shared: slices of ids of which each pair of one x and one y shares these members, ``least`` or more.

    Ids with the same set, but for members of one id only, are one class: classes are paired and compared, not ids. If
    ``within``, xs and ys are the same slice.
    """
    once = settled(members.select("id", "m").where("id is not null and m is not null").distinct())
    often = once.groupBy("m").agg(F.count("*").alias("n")).where("n > 1")
    sets = once.join(often, "m").groupBy("id").agg(F.array_sort(F.collect_list("m")).alias("set")).where(F.size("set") >= least)
    sizes = sets.groupBy("set").agg(F.count("*").alias("n"), F.min("id").alias("c"))
    slices = sets.join(sizes, "set").groupBy("c", "set", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / SLICE)).alias("slice"))
    slices = settled(slices.agg(F.collect_list("id").alias("ids")))
    classes = settled(slices.select("c", "set").distinct())
    pairs, _ = candidates(classes.select(F.col("c").alias("id"), F.explode("set").alias("m")), least)
    both = pairs.join(classes.toDF("a", "sa"), "a").join(classes.toDF("b", "sb"), "b").select("a", "b", F.array_sort(F.array_intersect("sa", "sb")).alias("shared"))
    both = both.where(F.size("shared") >= least).unionByName(classes.select(F.col("c").alias("a"), F.col("c").alias("b"), F.col("set").alias("shared")))
    met = both.join(slices.select(F.col("c").alias("a"), F.col("slice").alias("i"), F.col("ids").alias("xs")), "a").join(slices.select(F.col("c").alias("b"), F.col("slice").alias("j"), F.col("ids").alias("ys")), "b")
    return settled(met.where("a <> b or i <= j").select("xs", "ys", F.expr("a = b and i = j").alias("within"), "shared"))


def expanded(slices: DataFrame) -> DataFrame:
    """a, b (a < b) and the other columns, for all pairs of ``slices``, which are dealt anew before: pairs are not."""
    other = [c for c in slices.columns if c not in ("xs", "ys", "within")]
    x = slices.repartition(max(1, int(slices.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))).select("ys", "within", *other, F.explode("xs").alias("x"))
    y = x.select("x", "within", *other, F.explode("ys").alias("y")).where("not within or x < y")
    return y.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), *other)


def overlap_join(members: DataFrame, least: int) -> DataFrame:
    """a, b, shared: pairs of ids with at least ``least`` members in common, and those members. ``least`` is 1 or more.

    Repeated members count once, nulls not at all.
    """
    return expanded(overlapping(members, least))
