"""Text operators: one row to many, batch by batch."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chunking
from ..shipping import ship
from . import greedy

STRATEGIES: dict[str, Callable[..., list[tuple[int, int]]]] = {
    "fixed": chunking.fixed, "semantic": chunking.semantic, "adaptive": chunking.adaptive, "hierarchical": chunking.hierarchical, "token_aware": chunking.token_aware, "windows": chunking.windows,
    "balanced": lambda text, size=1000: chunking.balance(chunking.semantic(text, size), size),
}


def chunk(docs: DataFrame, strategy: str = "semantic", *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """id, chunk, start, size, hash, content for every chunk; ``auto`` picks a strategy by each text. Nulls have none."""

    ship(docs.sparkSession)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, text in zip(frame.iloc[:, 0], frame.iloc[:, 1]):
                if text:
                    for k, (a, b) in enumerate((STRATEGIES[chunking.pick_strategy(text)] if strategy == "auto" else STRATEGIES[strategy])(text, **how)):
                        rows.append((key, k, a, b - a, hashlib.sha256(text[a:b].encode()).hexdigest()[:16], text[a:b]))
            yield pd.DataFrame(rows, columns=["id", "chunk", "start", "size", "hash", "content"])

    return docs.where(F.col(text_col).isNotNull()).select(id_col, text_col).mapInPandas(cut, "id long, chunk int, start int, size int, hash string, content string")


def dedup_content(results: DataFrame, *, group_col: str, key_col: str, text_col: str, order_col: str, threshold: float = 0.8) -> DataFrame:
    """Per group, rows in order, each dropped if its words' Jaccard similarity with a kept one is ``threshold`` or more."""
    words = F.regexp_extract_all(F.lower(text_col), F.lit(r"(?U)(\S+)"), F.lit(1))
    return greedy.keep_first(results, group_col=group_col, key_col=key_col, order_col=order_col, words=words, threshold=threshold)


def pack_tokens(items: DataFrame, budget: int, *, group_col: str, key_col: str, priority_col: str, tokens_col: str, by: str = "priority") -> DataFrame:
    """Per group the keys that a greedy choice under a token budget takes: by priority, priority per token, or size."""
    tokens = F.col(tokens_col)
    order = {"priority": -F.col(priority_col), "efficiency": -F.col(priority_col) / F.greatest(tokens, F.lit(1)), "size": tokens}[by]
    return greedy.pack(items, budget, group_col=group_col, key_col=key_col, tokens_col=tokens_col, order=[order])


def hash_embeddings(docs: DataFrame, dims: int = 64, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    ship(docs.sparkSession)

    def embed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"id": frame.iloc[:, 0], "v": [chunking.hash_embedding(t or "", dims) for t in frame.iloc[:, 1]]})

    return docs.select(id_col, text_col).mapInPandas(embed, "id long, v array<double>")
