"""A training corpus from raw documents, stage by stage; each stage's result is written and read again by the next.

language: documents whose language is rejected go. lines: repeated lines go, and documents that have no words left by
that. near_duplicates: of each group of linked documents the one with the smallest id stays. decontamination: spans of
benchmark items go, and documents that are mostly such spans. bpe: the tokens of what is left, as digests.
All stages but the last return the columns of documents; where a text changes, n_chars follows it. Further columns,
whatever their names, come back as they were. Repeated rows stay repeated until the stage lines, which takes rows of one
id as one document; nulls and texts without letters go in the first stage; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import bpe, decontaminate, jaccard, language, lines
from quillgraph.llm.queries import word_bpe
from quillgraph.llm.tables import renamed, settled, small, table


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(columns) if "n_chars" in columns else docs.select(columns)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain, at = renamed(docs)
    model = language.fit(plain, id_col=at["doc_id"], text_col=at["text"], lang_col=at["lang"])
    return language.predict(plain, model, text_col=at["text"]).where("not rejected").select(plain.columns).toDF(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(lines.dedup(docs), docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    others = settled(jaccard.linked(docs).where("component_id <> doc_id").select("doc_id").distinct())
    return docs.join(small(others, jaccard.BROADCAST_ROWS), "doc_id", "left_anti").select(docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(decontaminate.remove(docs, table(spark, sf_dir, "benchmark")), docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(docs, word_bpe())


STAGES = [
    ("language", known_language),
    ("lines", without_repeated_lines),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("bpe", encoded),
]

#: No stage but sharding and URL filters has an equivalent in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = settled(docs)
    return docs
