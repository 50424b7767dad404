"""Connected components of an edge table, by smallest labels and pointer jumping; and components that grow link by link."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import done, settled, small

#: Labels up to this number are sent to all tasks; more are shuffled.
BROADCAST_ROWS = 200_000
#: Labels of labels that a round looks up.
JUMPS = 2


def components(links: DataFrame) -> DataFrame:
    """``id`` and ``component`` (the smallest id reachable) of every id that ``links`` (a, b) name.

    Each round takes the smallest label among neighbours, then the label of that label, and its label; so rounds are few.
    """
    edges = settled(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a <> b").distinct())
    label = settled(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")))
    rows = label.count()
    while True:
        sent = F.broadcast(label) if rows <= BROADCAST_ROWS else label
        far = edges.join(sent.toDF("b", "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m"))
        new = far.join(sent, "id").select("id", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        for _ in range(JUMPS):
            new = new.join(sent.toDF("component", "next"), "component", "left").select("id", "old", F.least("component", F.coalesce("next", "component")).alias("component"))
        new = settled(new)
        done(label)
        label = new.select("id", "component")
        label.settled_at = new.settled_at
        if not new.agg(F.count_if(F.col("old") != F.col("component"))).first()[0]:
            done(edges)
            return label


class Groups:
    """Components (``label``: id, component) that grow with each set of links; those already joined are asked no more."""

    def __init__(self):
        self.label: DataFrame | None = None

    def of(self, df: DataFrame, column: str, name: str) -> DataFrame:
        """``df`` with the component of the id in ``column``, the id itself where it has no links."""
        return self.labelled(df, column, "of_component").withColumn(name, F.coalesce("of_component", column)).drop("of_component")

    def labelled(self, df: DataFrame, column: str, name: str) -> DataFrame:
        """``df`` with the component of the id in ``column``, null where it has no links."""
        if self.label is None:
            return df.withColumn(name, F.lit(None).cast("long"))
        return df.join(small(self.label, BROADCAST_ROWS).toDF(column, name), column, "left")

    def across(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) whose ends are not connected yet, with the ends' components (ca, cb)."""
        return settled(self.of(self.of(pairs.select("a", "b"), "a", "ca"), "b", "cb").where("ca <> cb").select("a", "b", "ca", "cb"))

    def link(self, links: DataFrame) -> None:
        """Joins the components ca and cb of each of the links."""
        links = settled(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
        grown = components(links)
        if self.label is None:
            self.label = grown
        else:
            old = self.label.join(small(grown, BROADCAST_ROWS).toDF("component", "next"), "component", "left").select("id", F.coalesce("next", "component").alias("component"))
            label = settled(old.unionByName(grown.join(self.label.select("id"), "id", "left_anti")))
            done(grown, self.label)
            self.label = label
        done(links)
