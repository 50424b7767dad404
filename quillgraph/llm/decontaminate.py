"""Benchmark decontamination with a generalised suffix automaton of normalised test items.

Words are streamed through the automaton of all items; at each word it knows the longest run of words, ending
there, that some item holds. A run of ``window`` words or more is a hit, as is a whole item shorter than that.
Texts are searched whole; only stretches in which every word is known to the items are streamed, since no run can
leave them.

Nulls and texts without words are never hit; items without words are never found. Rows are independent: repeated rows
do no harm; an empty table of documents gives an empty one, one of items no hits; ties between items don't arise, since
all are reported. A text takes memory for its own words, whatever its length. Extra columns come back, whatever their
names; of ``mark`` those named as its own are replaced.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .arrowtext import ALNUM_LOWER, Words, buffers, slices
from .memory import lean
from .tables import renamed, settled

WINDOW = 10
#: Characters of items that one automaton holds (about 90 bytes each in every worker); more items are searched block by block.
BLOCK_CHARS = 4_000_000


@dataclass
class Automaton:
    """Generalised suffix automaton over sequences of hashed words."""

    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])

    def _clone(self, p: int, word: int, q: int) -> int:
        new = len(self.step)
        self.step.append(dict(self.step[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = new
        while p >= 0 and self.step[p].get(word) == q:
            self.step[p][word] = new
            p = self.link[p]
        return new

    def extend(self, last: int, word: int) -> int:
        """The state of the sequence that ends with ``word`` after the one of ``last``."""
        if (q := self.step[last].get(word)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, word, q)
        new = len(self.step)
        self.step.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        p = last
        while p >= 0 and word not in self.step[p]:
            self.step[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, word, q)
        return new


class ItemIndex:
    """Items as an automaton, with the items that each window of it comes from."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int = WINDOW):
        self.window, a = window, Automaton()
        items = [(key, words.tolist()) for key, words in items if len(words)]
        for _, words in items:
            last = 0
            for w in words:
                last = a.extend(last, w)
        self.a = a
        # The state whose strings of ``window`` words end each longer match.
        self.at_window = list(range(len(a.step)))
        for v in sorted(range(len(a.step)), key=a.length.__getitem__):
            if a.link[v] > 0 and a.length[a.link[v]] >= window:
                self.at_window[v] = self.at_window[a.link[v]]
        self.windows: dict[int, set[str]] = defaultdict(set)
        short: dict[int, dict[int, set[str]]] = defaultdict(lambda: defaultdict(set))
        for key, words in items:
            v = 0
            for i, w in enumerate(words):
                v = a.step[v][w]
                if i + 1 >= window:
                    self.windows[self.at_window[v]].add(key)
            short[v][len(words)].add(key)
        # Whole items that end wherever a state is reached, by length.
        self.short: dict[int, list[tuple[int, set[str]]]] = {}
        for v in sorted(range(len(a.step)), key=a.length.__getitem__):
            own = [*short[v].items()] if v in short else []
            if above := self.short.get(a.link[v], []):
                own = own + above
            if own:
                self.short[v] = own
        self.least = min([window, *(len(w) for _, w in items)], default=window)
        self.vocabulary = np.unique(np.array([w for _, words in items for w in words], np.uint64))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.vocabulary & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def known(self, word: np.ndarray) -> np.ndarray:
        """Which words some item has."""
        out = self.maybe[(word & np.uint64((1 << 20) - 1)).astype(np.int64)]
        at = np.flatnonzero(out)
        if len(at):
            near = np.minimum(np.searchsorted(self.vocabulary, word[at]), len(self.vocabulary) - 1)
            out[at] = self.vocabulary[near] == word[at]
        return out

    def search(self, words: list[int], at: int, spans: list[list[int]], found: set[str], whole: list[list[int]]) -> None:
        """Streams a stretch of words; adds spans of word positions (first, one past the last), items, and spans of whole items."""
        a, window = self.a, self.window
        step, link, length, at_window = a.step, a.link, a.length, self.at_window
        v = n = 0
        for i, w in enumerate(words, at + 1):
            to = step[v].get(w)
            while to is None and v:
                v = link[v]
                n = length[v]
                to = step[v].get(w)
            if to is None:
                continue
            v, n = to, n + 1
            hit = n if n >= window else 0
            if hit:
                found |= self.windows[at_window[v]]
            longest = 0
            for k, keys in self.short.get(v, ()):
                if k <= n:
                    found |= keys
                    longest = max(longest, k)
            if longest:
                whole.append([i - longest, i])
                hit = max(hit, longest)
            if hit:
                if spans and i - hit <= spans[-1][1]:
                    while spans and i - hit <= spans[-1][0]:
                        spans.pop()
                    if spans and i - hit <= spans[-1][1]:
                        spans[-1][1] = i
                        continue
                spans.append([i - hit, i])


def _item_words(texts: list) -> list[np.ndarray]:
    data, offsets = buffers(pa.array(texts, pa.string()))
    words = Words(data, offsets, ALNUM_LOWER)
    h = words.hashes()
    return [h[a:b] for a, b in zip(words.first, words.first[1:])]


_indexes: dict[str, ItemIndex] = {}


def _index(name: str, items: list[tuple[str, str]], window: int) -> ItemIndex:
    if name not in _indexes:
        _indexes.clear()
        _indexes[name] = ItemIndex(list(zip([k for k, _ in items], _item_words([t for _, t in items]))), window)
    return _indexes[name]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_chars: int):
    """Lists of items of bounded size; their number follows the size of the benchmark."""
    items = benchmark.select(F.col(id_col).cast("string").alias("k"), F.col(text_col).alias("t")).where("k is not null and t is not null")
    chars = items.agg(F.sum(F.length("t"))).first()[0] or 0
    n = -(-chars // block_chars) or 1
    for b in range(n):
        yield [(r.k, r.t) for r in items.where(F.pmod(F.xxhash64("k"), F.lit(n)) == b).collect()]


def mark(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS, then=None, then_schema=None) -> DataFrame:
    """``docs`` with columns hit_n_words, hit_spans (flat word positions: first, one past the last, ...), hit_items and hit_whole (as hit_spans, but of whole items). ``then``: applied to the marked batches in the same pass."""
    spark = docs.sparkSession
    ship(spark)
    own = ("hit_n_words", "hit_spans", "hit_items", "hit_whole")
    out = docs.drop(*own).select("*", F.lit(0).cast("long").alias(own[0]), F.array().cast("array<int>").alias(own[1]), F.array().cast("array<string>").alias(own[2]), F.array().cast("array<int>").alias(own[3]))
    schema = out.schema
    blocks = list(_blocks(benchmark, item_id, item_text, block_chars))
    for k, items in enumerate(blocks):
        last = then is not None and k + 1 == len(blocks)
        shared = spark.sparkContext.broadcast(items)
        name = hashlib.sha256(repr((window, items)).encode()).hexdigest()

        def run(batches, shared=shared, name=name, last=last):
            index = _index(name, shared.value, window)
            marked = (_mark_batch(index, batch, text_col) for whole in batches for batch in slices(whole, text_col))
            yield from then(marked) if last else marked

        out = (settled(out) if k else out).mapInArrow(lean(run), then_schema if last else schema)
    return out


def _merged(spans) -> list[int]:
    """Spans as flat positions, those that touch as one."""
    merged: list[int] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1]:
            merged[-1] = max(merged[-1], b)
        else:
            merged += [a, b]
    return merged


def _mark_batch(index: ItemIndex, batch: pa.RecordBatch, text_col: str) -> pa.RecordBatch:
    names = batch.schema.names
    words = Words(*buffers(batch.column(names.index(text_col))), ALNUM_LOWER)
    h = words.hashes()
    known = index.known(h)
    # Stretches of known words inside one row.
    edge = np.diff(np.concatenate([[0], known.view(np.int8), [0]]))
    cut = words.first[(words.first > 0) & (words.first < len(h))]
    cut = cut[known[cut] & known[cut - 1]] if len(cut) else cut
    start = np.sort(np.concatenate([np.flatnonzero(edge == 1), cut]))
    end = np.sort(np.concatenate([np.flatnonzero(edge == -1), cut]))
    long = end - start >= index.least
    start, end = start[long], end[long]
    row = np.searchsorted(words.first, start, "right") - 1
    spans, whole = ([[list(p) for p in zip(s[::2], s[1::2])] for s in batch.column(names.index(c)).to_pylist()] for c in ("hit_spans", "hit_whole"))
    found = [set(x) for x in batch.column(names.index("hit_items")).to_pylist()]
    for r, a, b in zip(row.tolist(), start.tolist(), end.tolist()):
        base, own = int(words.first[r]), []
        index.search(h[a:b].tolist(), a - base, own, found[r], whole[r])
        spans[r] += own
    columns = list(batch.columns)
    columns[names.index("hit_n_words")] = pa.array(np.diff(words.first), pa.int64())
    for name, values in (("hit_spans", [_merged(s) for s in spans]), ("hit_items", [sorted(x) for x in found]), ("hit_whole", [_merged(s) for s in whole])):
        columns[names.index(name)] = pa.array(values, batch.schema.field(name).type)
    return pa.RecordBatch.from_arrays(columns, schema=batch.schema)


def report(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Per row: id, words, words hit, items found, the digest of their sorted ids, and whether anything is hit."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    spans = F.col("hit_spans")
    n_hit = F.aggregate(
        F.transform(spans, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda s, x: s + x
    )
    return mark(docs, benchmark, **how).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("hit_n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("hit_items")), 256).alias("items_sha256"), (F.size(spans) > 0).alias("contaminated"),
    )


def remove(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", max_span: int = WINDOW, max_coverage: float = 0.8, **how) -> DataFrame:
    """``docs`` without hit spans of ``max_span`` words or more and without whole items of any length, and without rows of which more than ``max_coverage`` of the words is hit.

    Rows that nothing hits stay as they are, byte for byte.
    """
    original = docs.columns
    docs, at = renamed(docs)
    text_col, wanted, schema = at[text_col], set(docs.columns), docs.schema

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            column = batch.column(names.index(text_col))
            total = batch.column(names.index("hit_n_words")).to_pylist()
            spans, whole_items = (batch.column(names.index(c)).to_pylist() for c in ("hit_spans", "hit_whole"))
            touched = [i for i, s in enumerate(spans) if s]
            keep, texts = np.ones(batch.num_rows, bool), None
            if touched:
                texts = column.to_pylist()
                some = column.take(pa.array(touched))
                data, offsets = buffers(some)
                words = Words(data, offsets, ALNUM_LOWER)
                raw = data.tobytes()
                for k, i in enumerate(touched):
                    s, f = spans[i], int(words.first[k])
                    if sum(s[1::2]) - sum(s[::2]) > max_coverage * total[i]:
                        keep[i] = False
                        continue
                    out, at = [], int(offsets[k])
                    w = whole_items[i]
                    gone = _merged([(a, b) for a, b in zip(s[::2], s[1::2]) if b - a >= max_span] + [*zip(w[::2], w[1::2])])
                    for a, b in zip(gone[::2], gone[1::2]):
                        out.append(raw[at : int(words.start[f + a])])
                        at = int(words.end[f + b - 1])
                    out.append(raw[at : int(offsets[k + 1])])
                    texts[i] = b"".join(out).decode()
            columns = [pa.array(texts, f.type) if texts is not None and f.name == text_col else batch.column(names.index(f.name)) for f in batch.schema if f.name in wanted]
            yield pa.RecordBatch.from_arrays(columns, names=[n for n in names if n in wanted]).filter(pa.array(keep))

    return mark(docs, benchmark, text_col=text_col, then=run, then_schema=schema, **how).toDF(*original)
