"""Exact vector search in column expressions, and links between nearest vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vector_index import nearest_join


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: str, b: str) -> Column:
    """0 where a norm is 0; null where sizes differ."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) == F.size(b), F.when(norm > 0, dot(a, b) / norm).otherwise(0.0))


def nearest(vectors: DataFrame, query: list[float], k: int = 10, *, types: list | None = None, threshold: float | None = None, id_col: str = "vec_id", vector_col: str = "v", type_col: str = "label") -> DataFrame:
    """The k most similar vectors, types filtered before the cut so that k are found if there are k."""
    rows = vectors.where(F.size(vector_col) == len(query))
    rows = rows.where(F.col(type_col).isin(types)) if types else rows
    scored = rows.withColumn("q_", F.array(*map(F.lit, query))).withColumn("similarity", cosine(vector_col, "q_")).drop("q_")
    scored = scored.where(F.col("similarity") >= threshold) if threshold is not None else scored
    return scored.orderBy(F.desc("similarity"), id_col).limit(k)


def links(vectors: DataFrame, k: int = 10, *, id_col: str = "vec_id", vector_col: str = "v") -> DataFrame:
    """a, b, similarity: unordered pairs (a < b) where either is among the other's k nearest by cosine; ties to smaller ids."""
    near, _ = nearest_join(vectors, k, id_col=id_col, vector_col=vector_col)
    return near.select(F.least("query", "id").alias("a"), F.greatest("query", "id").alias("b"), "similarity").groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
