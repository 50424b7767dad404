"""N-Triples and Turtle-subset files as tables of triples, read and written by Spark's text source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = r'^\s*(?:<([^>]*)>|(_:\S+))\s+<([^>]*)>\s+(?:<([^>]*)>|(_:\S+)|"((?:[^"\\]|\\.)*)"(?:@([a-zA-Z0-9-]+))?(?:\^\^<([^>]*)>)?)\s*\.\s*$'


def _unescaped(c):
    for a, b in ((r"\\t", "\t"), (r"\\n", "\n"), (r"\\r", "\r"), (r'\\"', '"'), (r"\\\\", r"\\")):
        c = F.regexp_replace(c, a, b)
    return c


def read(spark: SparkSession, path: str) -> DataFrame:
    """s, p, o, o_type (uri, blank, literal), lang, datatype of every well-formed line; others are left out."""
    g = lambda i: F.nullif(F.regexp_extract("value", LINE, i), F.lit(""))
    rows = spark.read.text(path).where(F.col("value").rlike(LINE))
    o_type = F.when(g(4).isNotNull(), "uri").when(g(5).isNotNull(), "blank").otherwise("literal")
    return rows.select(F.coalesce(g(1), g(2)).alias("s"), g(3).alias("p"), F.coalesce(g(4), g(5), _unescaped(F.regexp_extract("value", LINE, 6))).alias("o"), o_type.alias("o_type"), g(7).alias("lang"), g(8).alias("datatype"))


def lines(triples: DataFrame) -> DataFrame:
    """One N-Triples line per triple; without o_type, objects that name a subject-like path are taken as literals."""
    node = lambda c: F.when(F.col(c).startswith("_:"), F.col(c)).otherwise(F.concat(F.lit("<"), F.col(c), F.lit(">")))
    text = F.col("o")
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(a), F.lit(b))
    has = lambda c: F.col(c) if c in triples.columns else F.lit(None).cast("string")
    literal = F.concat(F.lit('"'), text, F.lit('"'), F.coalesce(F.concat(F.lit("@"), has("lang")), F.lit("")), F.coalesce(F.concat(F.lit("^^<"), has("datatype"), F.lit(">")), F.lit("")))
    o = F.when(F.coalesce(has("o_type"), F.lit("literal")) == "literal", literal).otherwise(node("o"))
    return triples.select(F.concat(node("s"), F.lit(" <"), F.col("p"), F.lit("> "), o, F.lit(" .")).alias("value"))


def write(triples: DataFrame, path: str) -> None:
    lines(triples).write.mode("overwrite").text(path)
