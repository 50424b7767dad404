"""Quality rules with suffix-array repetition.

One suffix array over the words of a whole run of texts is built by prefix doubling; ranks start from (text, word), so
nothing repeats across texts. From the longest common prefixes of neighbours the longest repeat that begins at each
word follows: it is the depth of the deepest common-prefix interval that holds the suffix, and the spans of those of
at least ``min_repeat`` words together are the spans of all maximal repeated substrings. A text fails if too large a
fraction of its words is covered or its longest repeat is too long. Covered words are in repeated windows of three words
too, of which the base rule allows 50 %, so ``max_covered`` decides only well below that.

Nulls, empty texts and texts without words count zero everywhere; they have under 50 words and so fail the base rule.
Rows are independent: repeated rows do no harm, no ties arise, an empty table gives an empty one, and of extra columns,
whatever their names, none is read. Memory follows runs of 2 MB of text, or the longest text if that is longer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .arrowtext import SPACED, Words, buffers, slices, span_hashes, windows

MIN_REPEAT, MAX_COVERED, MAX_REPEAT = 8, 0.2, 150


def _dense(keys: np.ndarray) -> np.ndarray:
    """Ranks 0, 1, ... of the distinct keys."""
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def suffix_array(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of texts laid end to end and the common prefix of each suffix with the one before it, within its text.

    ``symbols``: a hash per word; ``first``: where each text begins (one more: the end).
    """
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    rank = _dense(symbols ^ (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    rank = _dense(row * (rank.max() + 1) + rank)  # ranks of one text are together
    left = np.repeat(first[1:], np.diff(first)) - np.arange(n)
    # A rank is the number of smaller suffixes; equal ones share it.
    order = np.argsort(rank, kind="stable")
    value = np.empty(n, np.int64)
    value[order] = _group_start(rank[order])
    levels, step = [value], 1
    active = _shared(value)
    while len(active) and step <= int(np.diff(first).max()):
        here = levels[-1]
        second = np.full(len(active), -1, np.int64)
        inside = left[active] > step
        second[inside] = here[active[inside] + step]
        order = np.lexsort((second, here[active]))
        active = active[order]
        a, b = here[active], second[order]
        same_a = np.concatenate([[False], a[1:] == a[:-1]])
        same = same_a & np.concatenate([[False], b[1:] == b[:-1]])
        index = np.arange(len(active))
        group = np.maximum.accumulate(np.where(same_a, 0, index))
        member = np.maximum.accumulate(np.where(same, 0, index))
        new = here.copy()
        new[active] = a + member - group
        levels.append(new)
        again = same.copy()
        again[:-1] |= same[1:]
        active = active[again]
        step *= 2
    sa = np.argsort(levels[-1], kind="stable")
    return sa, _common(sa, levels, left)


def _group_start(sorted_ranks: np.ndarray) -> np.ndarray:
    new = np.concatenate([[True], sorted_ranks[1:] != sorted_ranks[:-1]])
    return np.maximum.accumulate(np.where(new, np.arange(len(sorted_ranks)), 0))


def _shared(value: np.ndarray) -> np.ndarray:
    """Positions whose rank another one has too."""
    order = np.argsort(value, kind="stable")
    same = value[order][1:] == value[order][:-1]
    hit = np.zeros(len(value), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    return np.flatnonzero(hit)


def _common(sa: np.ndarray, levels: list[np.ndarray], left: np.ndarray) -> np.ndarray:
    """Longest common prefixes of neighbours, by descending powers of two."""
    out = np.zeros(len(sa), np.int64)
    k = np.arange(1, len(sa))
    k = k[levels[0][sa[1:]] == levels[0][sa[:-1]]]
    a, b, n = sa[k - 1], sa[k], np.zeros(len(k), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        width, ranks = 1 << level, levels[level]
        for _ in range(2):  # the highest level may fit twice
            fits = (left[a] - n >= width) & (left[b] - n >= width)
            same = np.zeros(len(k), bool)
            same[fits] = ranks[a[fits] + n[fits]] == ranks[b[fits] + n[fits]]
            n = n + same * width
    out[k] = n
    return out


def _count_rows(row: np.ndarray, rows: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(row, weights, minlength=rows).astype(np.int64)


def measure(column) -> dict[str, np.ndarray]:
    """All counts of a run of texts."""
    data, offsets = buffers(column)
    rows = len(offsets) - 1
    words = Words(data, offsets, SPACED)
    row, h = words.rows(), words.hashes()
    point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
    out = {"n_words": np.diff(words.first), "word_chars": _count_rows(row, rows, point[words.end] - point[words.start])}
    symbol = np.zeros(256, bool)
    symbol[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
    hits = np.concatenate([[0], np.cumsum(symbol[data])])
    out["n_symbols"] = hits[offsets[1:]] - hits[offsets[:-1]]

    # Lines: cut at line feeds and at the ends of texts.
    breaks = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    at = np.searchsorted(offsets, start, "right") - 1
    # A break at the very end of a text opens an empty line of it, which has no words.
    filled = start < offsets[-1]
    start, at = start[filled], at[filled]
    end = np.minimum(np.concatenate([start[1:], [len(data)]]), offsets[at + 1])
    end = end - ((end > start) & (data[np.maximum(end - 1, 0)] == 10))
    worded = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end, at = start[worded], end[worded], at[worded]
    key = span_hashes(data, start, end)
    order = np.lexsort((key, at))
    again = (at[order][1:] == at[order][:-1]) & (key[order][1:] == key[order][:-1])
    out["n_dup_lines"] = _count_rows(at[order][1:][again], rows)

    three, where = windows(h, words.first, 3)
    r3 = row[where] if len(where) else where
    order = np.lexsort((three, r3))
    same = (r3[order][1:] == r3[order][:-1]) & (three[order][1:] == three[order][:-1])
    twice = np.zeros(len(three), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    mark = np.zeros(len(h), bool)
    for i in range(3):
        mark[where[twice] + i] = True
    out["n_repeat_words"] = _count_rows(row[mark], rows)

    sa, lcp = suffix_array(h, words.first)
    reach = np.zeros(len(h), np.int64)
    if len(sa):
        following = np.concatenate([lcp[1:], [0]])
        reach[sa] = np.maximum(lcp, following)
    out["longest_repeat"] = np.zeros(rows, np.int64)
    np.maximum.at(out["longest_repeat"], row, reach)
    out["_reach"], out["_row"] = reach, row
    return out


def covered_words(counts: dict[str, np.ndarray], rows: int, min_repeat: int) -> np.ndarray:
    """Words of each text inside repeats of at least ``min_repeat`` words."""
    reach, row = counts["_reach"], counts["_row"]
    deep = np.flatnonzero(reach >= min_repeat)
    edge = np.zeros(len(reach) + 1, np.int64)
    np.add.at(edge, deep, 1)
    np.add.at(edge, deep + reach[deep], -1)
    return _count_rows(row[np.cumsum(edge[:-1]) > 0], rows)


BASE = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Per row: id, counts, base_failed, kept, and the method's figures covered_words and longest_repeat."""
    ship(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, n_words long, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, kept boolean, covered_words long, longest_repeat long"

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                m = measure(batch.column(1))
                n, covered = m["n_words"], covered_words(m, batch.num_rows, min_repeat)
                failed = (n < 50) | (100 * m["n_repeat_words"] > 50 * n)
                bad = (covered > max_covered * n) | (m["longest_repeat"] > max_repeat)
                arrays = [batch.column(0), n, *(m[c] for c in BASE), failed, ~failed & ~bad, covered, m["longest_repeat"]]
                yield pa.RecordBatch.from_arrays([pa.array(a) if isinstance(a, np.ndarray) else a for a in arrays], names=["doc_id", "n_words", *BASE, "base_failed", "kept", "covered_words", "longest_repeat"])

    return docs.mapInArrow(run, schema)
