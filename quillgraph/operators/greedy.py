"""Greedy choices in order, without a task that holds a whole group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import dropped, settled

#: Rounds in which only first rows of buckets may stay, before all candidates left are paired.
LEADER_ROUNDS = 3
#: Rows of a group looked at in a round: up to so many Spark cuts a group in every task before rows are shuffled.
GROUP_ROWS = 1000


def keep_first(rows: DataFrame, *, group_col: str, key_col: str, order_col: str, words: Column, threshold: float) -> DataFrame:
    """group and key of the rows that stay if each goes that is like one kept before it in its group.

    Like: the Jaccard similarity of their ``words`` (an array) is ``threshold`` or more. Rows go by ``order_col``, then
    key; rows without words stay. Keys are unique in a group.

    Of equal sets only the first row can stay. Each set enters one bucket for each of its rarest words, as many as surely
    hold one of every set as similar (prefix filter). In the first rounds rows stay that come first in all their buckets,
    and what is like them goes, so a large group of near copies is compared with its first member only. What is left
    is paired within buckets; then, round by round, rows stay that no earlier one left is like, and what is like
    them goes.
    """
    g = F.xxhash64(F.lit(1), F.col(group_col))
    sets = rows.select(F.col(group_col).alias("grp"), g.alias("g"), F.struct(F.col(order_col).alias("at"), F.col(key_col).alias("key")).alias("row"), F.array_sort(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))).alias("set"))
    sets = sets.withColumn("set", F.coalesce("set", F.array().cast("array<bigint>")))
    bare = sets.where(F.size("set") == 0).select("grp", "row.key")
    firsts = settled(sets.where(F.size("set") > 0).groupBy("g", "set").agg(F.min("row").alias("row"), F.first("grp").alias("grp")))
    word = firsts.select("g", "row", F.explode("set").alias("w"))
    seen = word.groupBy("w").agg(F.count("*").alias("n"))
    ordered = word.join(seen, "w").groupBy("g", "row").agg(F.array_sort(F.collect_list(F.struct("n", "w"))).alias("by"))
    size = F.size("by")
    prefix = F.slice("by", F.lit(1), size - F.ceil(threshold * size - 1e-9).cast("int") + 1)
    entry = settled(ordered.select("g", "row", size.alias("size"), F.size(prefix).alias("buckets"), F.explode(F.transform(prefix, lambda x: x.w)).alias("w")))

    def like(pairs: DataFrame) -> DataFrame:
        """Of pairs (g, a, b) those whose sets are alike."""
        both = F.size(F.array_intersect("sa", "sb")).cast("double")
        sa, sb = firsts.select("g", F.col("row").alias("a"), F.col("set").alias("sa")), firsts.select("g", F.col("row").alias("b"), F.col("set").alias("sb"))
        return pairs.distinct().join(sa, ["g", "a"]).join(sb, ["g", "b"]).where(both / (F.size("sa") + F.size("sb") - both) >= threshold).select("g", "a", "b")

    sized = (F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9) & (F.col("a") < F.col("b"))
    side = lambda df, name: df.select("g", "w", F.col("row").alias(name), F.col("size").alias(f"n{name}"))
    stays: list[DataFrame] = []
    for _ in range(LEADER_ROUNDS):
        lead = entry.groupBy("g", "w").agg(F.min("row").alias("row"))
        first = settled(entry.join(lead, ["g", "w", "row"], "left_semi").groupBy("g", "row", "buckets").agg(F.count("*").alias("n")).where("n = buckets").select("g", "row"))
        kept = entry.join(first, ["g", "row"], "left_semi")
        gone = settled(like(side(kept, "a").join(side(entry, "b"), ["g", "w"]).where(sized).select("g", "a", "b")).select("g", F.col("b").alias("row")).distinct())
        left = settled(entry.join(first.unionByName(gone), ["g", "row"], "left_anti"))
        dropped(entry, gone)
        stays.append(first)
        entry = left
    edge = settled(like(side(entry, "a").join(side(entry, "b"), ["g", "w"]).where(sized).select("g", "a", "b")))
    undecided = settled(entry.select("g", "row").distinct())
    while not undecided.isEmpty():
        first = settled(undecided.join(edge.select("g", F.col("b").alias("row")), ["g", "row"], "left_anti"))
        gone = settled(edge.join(first.withColumnRenamed("row", "a"), ["g", "a"], "left_semi").select("g", F.col("b").alias("row")).distinct())
        over = first.unionByName(gone)
        left = settled(undecided.join(over, ["g", "row"], "left_anti"))
        fewer = settled(edge.join(over.withColumnRenamed("row", "a"), ["g", "a"], "left_anti").join(over.withColumnRenamed("row", "b"), ["g", "b"], "left_anti"))
        dropped(undecided, edge, gone)
        undecided, edge = left, fewer
        stays.append(first)
    chosen = firsts.join(reduce(DataFrame.unionByName, stays), ["g", "row"], "left_semi").select("grp", "row.key")
    out = settled(chosen.unionByName(bare))
    dropped(firsts, entry, edge, undecided, *stays)
    return out.toDF(group_col, key_col)


def pack(items: DataFrame, budget: int, *, group_col: str, key_col: str, tokens_col: str, order: list[Column]) -> DataFrame:
    """group and key of the items that a greedy choice in ``order`` takes: each one that still fits the group's budget.

    What is larger than a group's rest can't be taken any more and goes at once. A round looks at the first items left in
    order, ``budget`` or ``GROUP_ROWS`` of each group, and takes the run of them that fits together (items without tokens
    always fit). Spark cuts every task's rows of a group to as many before they are shuffled.
    """
    g = F.xxhash64(F.lit(1), F.col(group_col))
    sized = items.select(F.col(group_col).alias("grp"), g.alias("g"), F.col(key_col).alias("key"), F.col(tokens_col).cast("long").alias("tokens"), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]).alias("place"))
    free = sized.where("tokens <= 0").select("grp", "key")
    open_items = settled(sized.where((F.col("tokens") > 0) & (F.col("tokens") <= budget)))
    rest = settled(open_items.select("g").distinct().withColumn("rest", F.lit(budget).cast("long")))
    taken: list[DataFrame] = []
    while not open_items.isEmpty():
        by = Window.partitionBy("g").orderBy("place", "key")
        near = open_items.withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= min(budget, GROUP_ROWS))
        run = near.withColumn("sum", F.sum("tokens").over(by.rowsBetween(Window.unboundedPreceding, 0))).join(rest, "g")
        new = settled(run.where("sum <= rest").select("grp", "g", "key", "place", "tokens"))
        left = settled(rest.join(new.groupBy("g").agg(F.sum("tokens").alias("used")), "g", "left").select("g", (F.col("rest") - F.coalesce("used", F.lit(0))).alias("rest")))
        fewer = settled(open_items.join(new.select("g", "key"), ["g", "key"], "left_anti").join(left, "g").where("tokens <= rest").drop("rest"))
        dropped(open_items, rest)
        open_items, rest = fewer, left
        taken.append(new)
    chosen = [t.select("grp", "key") for t in taken]
    out = settled(reduce(DataFrame.unionByName, chosen, free))
    dropped(open_items, rest, *taken)
    return out.toDF(group_col, key_col)
