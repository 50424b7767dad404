"""Language-model scoring by deleted interpolation.

Maximum-likelihood estimates of orders 1 to ``order`` and a uniform share are mixed with weights that depend on how
often the context was seen. The weights are learned by expectation-maximisation on a part of the training texts whose
own counts are left out for that (``develop``); the counts that score come from all training texts.

Texts are dealt to batches of bounded size by a hash. Each batch asks for the counts of its distinct n-grams; requests
are dealt by key range, summed, and answered in the same order. A frequent n-gram is one entry per batch however often
it stands, and no task or driver holds the counts of the whole corpus. What reaches the driver is two totals and a
histogram of bounded size for the weights.

Null texts are empty: one end token. Rows are independent but for the counts; repeated rows count each time. With
nothing to learn from, all words are unknown and every score is 0 (one type, the unknown one). An empty table gives an
empty one; equal counts need no tie rule; of extra columns, whatever their names, none is read. A batch holds
``batch_bytes`` of text or one text, if that is longer, and its n-grams in memory.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .arrowtext import SPACED_LOWER, Words, buffers, mix
from .blobs import counted, pack, ranges, unpack
from .tables import parts, release, settled

#: Bytes of text in a batch, and of text for each range of keys.
ORDER, BATCH_BYTES, RANGE_BYTES = 3, 8_000_000, 16_000_000
_U = np.uint64
END, BEGIN = _U(0x1F83D9ABFB41BD6B), _U(0x5BE0CD19137E2179)
#: Context-frequency buckets per order (0, 1, 2, 3-4, 5-8, ...), and octaves of estimates over the uniform share.
BUCKETS, OCTAVES = 14, 24


def tokens(column) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's words and an end, and where each text begins (one more: all)."""
    words = Words(*buffers(column), SPACED_LOWER)
    first = words.first + np.arange(len(words.first))
    out = np.full(first[-1], END, _U)
    out[np.arange(len(words)) + words.rows()] = words.hashes()
    return out, first


def grams(token: np.ndarray, first: np.ndarray, order: int) -> list[np.ndarray]:
    """Keys of the n-grams that end at each token, for n = 1 to order; before a text stand begin marks.

    Keys have 50 bits, to spare disk: among 10^11 different n-grams one in 11,000 shares its key, and count, with another.
    """
    out, n = [token], len(token)
    place = np.arange(n) - np.repeat(first[:-1], np.diff(first))
    key = token
    for k in range(1, order):
        before = np.empty(n, _U)
        before[k:] = token[: max(n - k, 0)]
        before[place < k] = BEGIN
        key = mix(key * _U(0x9E3779B97F4A7C15) + mix(before + _U(k))) >> _U(14) << _U(14)
        out.append(key)
    return out


def bucket(count: np.ndarray) -> np.ndarray:
    """0 for unseen, then octaves, the last one open."""
    return np.where(count > 0, np.minimum(np.ceil(np.log2(np.maximum(count, 1))) + 1, BUCKETS - 1), 0).astype(np.int64)


@dataclass
class Mixture:
    """weights[b]: shares of uniform, order 1, ..., for tokens of context class b."""

    total: int
    types: int
    weights: np.ndarray


def context_class(context: list[np.ndarray]) -> np.ndarray:
    """One class for the frequencies of all contexts: of the longest seen one, and its length."""
    out = np.zeros(len(context[0]), np.int64)
    for k, c in enumerate(context[1:], 1):
        out = np.where(c > 0, (k - 1) * BUCKETS + bucket(c), out)
    return out


def ratios(count: list[np.ndarray], context: list[np.ndarray], types: int) -> list[np.ndarray]:
    """Estimates of each order over the uniform share."""
    return [np.divide(n.astype(float) * (types + 1), c, out=np.zeros(len(n)), where=c > 0) for n, c in zip(count, context)]


def learn_weights(cells: np.ndarray, n: np.ndarray, order: int, rounds: int = 60) -> np.ndarray:
    """Expectation-maximisation over a histogram; cells: class, then octave + 1 of each order (0: no estimate)."""
    classes = max(1, (order - 1) * BUCKETS)
    weights = np.full((classes, order + 1), 1.0 / (order + 1))
    if not len(n):
        return weights
    value = np.concatenate([np.ones((len(n), 1)), np.where(cells[:, 1:] > 0, 2.0 ** (cells[:, 1:] - 4.5), 0.0)], 1)
    own = cells[:, 0]
    for _ in range(rounds):
        share = weights[own] * value
        share *= (n / share.sum(1))[:, None]
        sums = np.full((classes, order + 1), 1e-3)  # classes without tokens stay even; no share is exactly 0
        np.add.at(sums, own, share)
        weights = sums / sums.sum(1, keepdims=True)
    return weights


def _cells(ratio: list[np.ndarray], own: np.ndarray) -> np.ndarray:
    code = own.astype(np.int64)
    for r in ratio:
        level = np.where(r > 0, np.clip(np.floor(np.log2(np.maximum(r, 1e-9))) + 4, 0, OCTAVES - 2) + 1, 0).astype(np.int64)
        code = code * OCTAVES + level
    return code


def _decode(code: np.ndarray, order: int) -> np.ndarray:
    out = []
    for _ in range(order):
        out.append(code % OCTAVES)
        code = code // OCTAVES
    return np.stack([code, *out[::-1]], 1)


def _request(key, table: pa.Table, order: int, n_parts: int) -> pa.Table:
    """One row per partition: this batch's distinct n-grams and how often training texts have them."""
    token, first = tokens(table.column("text").combine_chunks())
    train = np.repeat(table.column("train").to_numpy(), np.diff(first)).astype(np.int64)
    blobs: list[list[bytes]] = [[] for _ in range(n_parts)]
    for gram in grams(token, first, order):
        keys, n = counted(gram, train)
        cut = ranges(keys, n_parts)
        for p in range(n_parts):
            a, b = cut[p], cut[p + 1]
            blobs[p] += [pack(keys[a:b], True), pack(n[a:b].astype(np.uint32))]
    return pa.table({"part": pa.array(range(n_parts), pa.int32()), "batch": pa.array([key[0].as_py()] * n_parts, pa.int64()), "dev": pa.array([key[1].as_py()] * n_parts, pa.bool_()), "blobs": pa.array(blobs, pa.list_(pa.binary()))})


def _answer(key, table: pa.Table, order: int) -> pa.Table:
    """Counts without and with the development texts for each batch's n-grams of this partition, in the order asked."""
    batches, dev = table.column("batch").to_pylist(), table.column("dev").to_pylist()
    blobs = table.column("blobs").to_pylist()
    answers: list[list[bytes]] = [[] for _ in batches]
    total = types = without = 0
    for k in range(order):
        asked = [unpack(b[2 * k], _U, True) for b in blobs]
        n = [unpack(b[2 * k + 1], np.int64) for b in blobs]
        size = np.cumsum([0, *map(len, asked)])
        keys, where = np.unique(np.concatenate(asked), return_inverse=True)
        counts = np.concatenate(n)
        every = np.bincount(where, counts, len(keys)).astype(np.uint64)
        is_main = np.repeat([not d for d in dev], np.diff(size))
        main = np.bincount(where[is_main], counts[is_main], len(keys)).astype(np.uint64)
        if k == 0:
            total, types = int(every.astype(np.int64).sum()), int((every > 0).sum())
            without = int(main.astype(np.int64).sum())
        for i, out in enumerate(answers):
            mine = where[size[i] : size[i + 1]]
            out += [pack(every[mine]), pack(main[mine]) if dev[i] else b""]
    rows = len(batches)
    return pa.table({"batch": pa.array(batches, pa.int64()), "part": pa.array([key[0].as_py()] * rows, pa.int32()), "answers": pa.array(answers, pa.list_(pa.binary())), "total": pa.array([total] + [0] * (rows - 1), pa.int64()), "types": pa.array([types] + [0] * (rows - 1), pa.int64()), "main": pa.array([without] + [0] * (rows - 1), pa.int64())})


def _lookup(texts: pa.Table, answers: pa.Table, order: int, column: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Per token the counts of its n-grams and of their contexts (the first context: all tokens, set by the caller)."""
    token, first = tokens(texts.column("text").combine_chunks())
    got = sorted(zip(answers.column("part").to_pylist(), answers.column("answers").to_pylist()))
    count = []
    ends = None
    for k, gram in enumerate(grams(token, first, order)):
        keys, where = np.unique(gram, return_inverse=True)
        n = np.concatenate([unpack(blobs[2 * k + column], np.int64) for _, blobs in got])
        count.append(n[where])
        if k == 0:
            ends = int(n[np.searchsorted(keys, END)])
    context = [np.zeros(0)]
    begins = first[:-1]
    for k in range(1, order):  # what precedes a token, or the number of texts where nothing does
        c = np.concatenate([[0], count[k - 1][:-1]])
        c[begins] = ends
        context.append(c)
    return first, count, context, token


def score(docs: DataFrame, train: Column, develop: Column, *, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Per row: doc_id, train, n_tokens, n_known, train_tokens, base_score (add-one unigrams) and score, both log10.

    ``train``: whether a row is learned from; ``develop``: which of those teach the weights.
    """
    spark = docs.sparkSession
    ship(spark)
    learned = F.coalesce(train, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), learned.alias("train"), (learned & F.coalesce(develop, F.lit(False))).alias("dev"))
    size = rows.groupBy("dev").agg(F.sum(F.octet_length("text")).alias("bytes")).collect()
    batches = F.create_map(*[x for d in (False, True) for x in (F.lit(d), F.lit(int(max([0, *(r["bytes"] or 0 for r in size if r.dev == d)]) // batch_bytes + 1)))])
    texts = rows.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text"), F.element_at(batches, F.col("dev"))) * 2 + F.col("dev").cast("int"))
    n_parts = max(parts(spark), sum(r["bytes"] or 0 for r in size) // RANGE_BYTES)
    asked = texts.groupBy("batch", "dev").applyInArrow(lambda key, t: _request(key, t, order, n_parts), "part int, batch long, dev boolean, blobs array<binary>")
    answered = settled(asked.groupBy("part").applyInArrow(lambda key, t: _answer(key, t, order), "batch long, part int, answers array<binary>, total long, types long, main long"))
    release(spark)
    total, types, main = (x or 0 for x in answered.agg(F.sum("total"), F.sum("types"), F.sum("main")).first())

    def histogram(key, texts, answers):
        _, count, context, token = _lookup(texts, answers, order, 1)
        context[0] = np.full(len(token), max(1, main))
        got, n = counted(_cells(ratios(count, context, types), context_class(context)))
        return pa.table({"cell": pa.array(got, pa.int64()), "n": pa.array(n, pa.int64())})

    seen = texts.where("dev").groupBy("batch").cogroup(answered.where("batch % 2 = 1").groupBy("batch")).applyInArrow(histogram, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    release(spark)
    cells, n = np.array([r.cell for r in seen], np.int64), np.array([r.n for r in seen], float)
    model = Mixture(total, types, learn_weights(_decode(cells, order) if len(n) else cells, n, order))

    def scored(key, texts, answers):
        first, count, context, token = _lookup(texts, answers, order, 0)
        context[0] = np.full(len(token), model.total)
        value = [np.ones(len(token)), *ratios(count, context, model.types)]
        w = model.weights[context_class(context)]
        # What an order without an estimate would get goes to the others.
        there = np.stack([np.ones(len(token), bool)] + [c > 0 for c in context], 1)
        w = w * there
        p = sum(w[:, k] * v for k, v in enumerate(value)) / w.sum(1) / (model.types + 1)
        base = np.log10((count[0] + 1) / (model.total + model.types + 1))
        add = lambda x: np.add.reduceat(x, first[:-1])
        held = texts.column("train")
        return pa.table({"doc_id": texts.column("doc_id"), "train": held, "n_tokens": pa.array(np.diff(first), pa.int64()), "n_known": pa.array(add((count[0] > 0).astype(np.int64)), pa.int64()), "train_tokens": pa.array([model.total] * len(held), pa.int64()), "base_score": pa.array(add(base), pa.float64()), "score": pa.array(add(np.log10(p)), pa.float64())})

    return texts.groupBy("batch").cogroup(answered.groupBy("batch")).applyInArrow(scored, "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
