"""Removal of repeated passages, found by difference-cover anchors.

A window is ``n`` consecutive words of a document. A word goes if a window covers it whose words also start earlier: in a
document of smaller id, or in the same one at an earlier word. All windows are judged on the input.

Only the windows of ``n - period + 1`` words that begin at cover positions are hashed at first (anchors). The cover holds
two numbers for every difference modulo the period, so for any two places there is a shift of less than a period that
puts both on cover positions: two equal windows always share an anchor at the same offset. Anchors that occur twice
anywhere are then extended to the windows around them, and of each such window the earliest place is sought.

Texts are packed into batches of about ``batch_bytes``. A batch sends each distinct key once, in sorted runs by key
range, and gets one bit (anchors) or the keys it has lost (windows) back. So a passage that thousands of documents share
is one key a batch, and no task holds all places of anything. Keys have 64 bits: different ones count as equal with a
chance of about m²/2⁶⁵ for m of them.

Null texts, empty ones and those of under ``n`` words keep all they have. Rows of one id are one document: equal windows
at the same word of both stay, at a later word they go. Rows without an id are one document after all others. Repeated
rows stay repeated; no other ties arise, since (id, first word) decides. An empty table gives an empty one; of extra
columns, whatever their names, none is read. Memory follows a batch, or the longest text if that is longer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .arrowtext import SPACED, Words, buffers, slices, windows
from .blobs import pack, ranges, unpack
from .memory import lean, lean_group, trim
from .tables import done, parts, settled

WINDOW, PERIOD = 20, 7
#: Bytes of text in a batch, and of text for each range of keys.
BATCH_BYTES, RANGE_BYTES = 4_000_000, 16_000_000
_U = np.uint64
NO_ID = np.iinfo(np.int64).max


def difference_cover(period: int) -> list[int]:
    """Residues whose differences are all residues; greedily, each one that adds the most differences."""
    cover, seen = [0], {0}
    while len(seen) < period:
        gain = lambda c: len({(c - x) % period for x in cover} | {(x - c) % period for x in cover} | seen)
        best = max(range(period), key=lambda c: (gain(c), -c))
        seen |= {(best - x) % period for x in cover} | {(x - best) % period for x in cover}
        cover.append(best)
    return sorted(cover)


class Batch:
    """The texts of one batch as words, with the hashes of their windows."""

    def __init__(self, blob: bytes, n: int, period: int):
        self.docs = pa.ipc.open_stream(blob).read_all()
        self.n, self.period = n, min(period, n)
        self.ids = np.array(self.docs.column("doc_id").fill_null(NO_ID).to_numpy(), np.int64)
        self.words = Words(*buffers(self.docs.column("text")), SPACED)
        self.hash = self.words.hashes()

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the anchors and the words they begin at."""
        key, at = windows(self.hash, self.words.first, self.n - self.period + 1)
        place = at - np.repeat(self.words.first[:-1], np.diff(self.words.first))[at]
        on = np.isin(place % self.period, difference_cover(self.period))
        return key[on], at[on]

    def around(self, anchor_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows that hold one of these anchors: hashes and first words."""
        wanted = np.zeros(len(self.hash) + 1, np.int64)
        np.add.at(wanted, np.maximum(anchor_at - self.period + 1, 0), 1)
        np.add.at(wanted, anchor_at + 1, -1)
        key, at = windows(self.hash, self.words.first, self.n)
        on = np.cumsum(wanted)[at] > 0
        return key[on], at[on]

    def place(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document id and word within the document of words of the batch."""
        row = np.searchsorted(self.words.first, at, "right") - 1
        return self.ids[row], at - self.words.first[row]


def earliest(key: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by key, document and start; and for each in that order, whether it stands at the first place of its key."""
    order = np.lexsort((start, doc, key))
    key, doc, start = key[order], doc[order], start[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    return order, (doc == doc[head]) & (start == start[head])


def _packed(docs: DataFrame, batch_bytes: int) -> DataFrame:
    """batch, docs: one row for each run of about ``batch_bytes`` of text, its rows as one compressed Arrow stream."""

    def run(batches):
        n = 0
        for whole in batches:
            for part in slices(whole, "text", batch_bytes):
                out = pa.BufferOutputStream()
                with pa.ipc.new_stream(out, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_batch(part)
                key = (TaskContext.get().partitionId() << 32) + n
                n += 1
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["batch", "docs"])

    return settled(docs.mapInArrow(lean(run), "batch long, docs binary"), codec="uncompressed")


def _sent(batch: int, key: np.ndarray, n_parts: int, **more: np.ndarray) -> pa.Table:
    """One row per key range: the batch's sorted distinct keys there, and what goes with them."""
    cut = ranges(key, n_parts)
    runs = [(p, cut[p], cut[p + 1]) for p in range(n_parts) if cut[p] < cut[p + 1]]
    columns = {"part": pa.array([p for p, *_ in runs], pa.int32()), "batch": pa.array([batch] * len(runs), pa.int64()), "keys": pa.array([pack(key[a:b], True) for _, a, b in runs], pa.binary())}
    return pa.table(columns | {name: pa.array([pack(v[a:b]) for _, a, b in runs], pa.binary()) for name, v in more.items()})


def _repeated(table: pa.Table) -> pa.Table:
    """For each batch, bits that say which of its anchors of this range other batches have too."""
    sent = [unpack(b, _U, True) for b in table.column("keys").to_pylist()]
    _, where, n = np.unique(np.concatenate(sent), return_inverse=True, return_counts=True)
    bits, at = [], 0
    for keys in sent:
        bits.append(np.packbits(n[where[at : at + len(keys)]] > 1).tobytes())
        at += len(keys)
    return pa.table({"batch": table.column("batch"), "part": table.column("part"), "bits": pa.array(bits, pa.binary())})


def _lost(table: pa.Table) -> pa.Table:
    """For each batch, those of its windows of this range whose earliest place is in another one."""
    sent = [unpack(b, _U, True) for b in table.column("keys").to_pylist()]
    doc, start = (np.concatenate([unpack(b, np.int64) for b in table.column(c).to_pylist()]) for c in ("doc", "start"))
    keys = np.concatenate(sent)
    order, first = earliest(keys, doc, start)
    late = np.zeros(len(keys), bool)
    late[order[~first]] = True
    lost, at = [], 0
    for mine in sent:
        lost.append(pack(mine[late[at : at + len(mine)]], True))
        at += len(mine)
    return pa.table({"batch": table.column("batch"), "part": table.column("part"), "lost": pa.array(lost, pa.binary())})


def _spans(gone: np.ndarray) -> list[dict]:
    """Runs of removed words: first word, and the one after the last."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])]


def _trimmed(run):
    """A function of two tables (for cogroups) that gives memory back at its end."""

    def both(left, right):
        try:
            return run(left, right)
        finally:
            trim()

    return both


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = WINDOW, period: int = PERIOD, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, text (the words kept, joined by one space) and removed (spans of words)."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    batches = _packed(rows, batch_bytes)
    n_parts = max(parts(spark), batches.count() * batch_bytes // RANGE_BYTES)

    def anchors(frames):
        for frame in frames:
            for batch, blob in zip(frame.column(0).to_pylist(), frame.column(1)):
                key, _ = Batch(blob.as_py(), n, period).anchors()
                yield from _sent(batch, np.unique(key), n_parts).to_batches()

    asked = batches.mapInArrow(lean(anchors), "part int, batch long, keys binary")
    shared = settled(asked.groupBy("part").applyInArrow(lean_group(_repeated), "batch long, part int, bits binary"), codec="uncompressed")

    def extended(left: pa.Table, right: pa.Table) -> pa.Table:
        """The windows around anchors that occur twice, each at its first place in the batch."""
        batch = Batch(left.column("docs")[0].as_py(), n, period)
        anchor, at = batch.anchors()
        distinct, where, count = np.unique(anchor, return_inverse=True, return_counts=True)
        cut, twice = ranges(distinct, n_parts), count > 1
        for p, bits in zip(right.column("part").to_pylist(), right.column("bits").to_pylist()):
            twice[cut[p] : cut[p + 1]] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=cut[p + 1] - cut[p]).astype(bool)
        window, begins = batch.around(at[twice[where]])
        doc, start = batch.place(begins)
        order = np.lexsort((start, doc, window))
        window, doc, start = window[order], doc[order], start[order]
        new = np.ones(len(window), bool)
        new[1:] = window[1:] != window[:-1]
        return _sent(left.column("batch")[0].as_py(), window[new], n_parts, doc=doc[new].astype(_U), start=start[new].astype(np.uint32))

    wide = batches.groupBy("batch").cogroup(shared.groupBy("batch")).applyInArrow(_trimmed(extended), "part int, batch long, keys binary, doc binary, start binary")
    late = settled(wide.groupBy("part").applyInArrow(lean_group(_lost), "batch long, part int, lost binary"), codec="uncompressed")
    done(shared)

    def cleaned(left: pa.Table, right: pa.Table) -> pa.Table:
        batch = Batch(left.column("docs")[0].as_py(), n, period)
        window, at = windows(batch.hash, batch.words.first, n)
        order, first = earliest(window, *batch.place(at))
        removed = np.zeros(len(window), bool)
        removed[order[~first]] = True
        lost = [unpack(b, _U, True) for _, b in sorted(zip(right.column("part").to_pylist(), right.column("lost").to_pylist()))]
        if lost:
            removed |= np.isin(window, np.concatenate(lost))
        edge = np.zeros(len(batch.hash) + 1, np.int64)
        np.add.at(edge, at[removed], 1)
        np.add.at(edge, at[removed] + n, -1)
        gone = np.cumsum(edge)[:-1] > 0
        text, spans, count = [], [], []
        for i, whole in enumerate(batch.docs.column("text")):
            a, b = batch.words.first[i], batch.words.first[i + 1]
            mine, words = gone[a:b], whole.as_py().encode().split()
            text.append(b" ".join(w for w, g in zip(words, mine.tolist()) if not g).decode() if mine.any() else b" ".join(words).decode())
            spans.append(_spans(mine))
            count.append(int(mine.sum()))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({"doc_id": batch.docs.column("doc_id"), "n_words": pa.array(np.diff(batch.words.first), pa.int64()), "n_removed": pa.array(count, pa.int64()), "text": pa.array(text, pa.string()), "removed": pa.array(spans, span)})

    return batches.groupBy("batch").cogroup(late.groupBy("batch")).applyInArrow(_trimmed(cleaned), "doc_id long, n_words long, n_removed long, text string, removed array<struct<start:long,end:long>>")


def sql(*, n: int = WINDOW) -> str:
    """The same over ``documents``, with every window of every text written out, for an independent engine."""
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, {NO_ID}) AS d, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS ws FROM documents),
starts AS (SELECT r, d, ws, unnest(range(1, len(ws) - {n} + 2)) AS k FROM docs),
spans AS (SELECT r, d, k, md5(array_to_string(ws[k : k + {n} - 1], ' ')) AS key FROM starts),
earliest AS (SELECT key, min((d, k)) AS first_at FROM spans GROUP BY key),
gone AS (SELECT DISTINCT r, k + unnest(range({n})) AS place FROM spans JOIN earliest USING (key) WHERE (d, k) > first_at),
words AS (SELECT r, unnest(range(1, len(ws) + 1)) AS place, unnest(ws) AS w FROM docs),
kept AS (SELECT r, string_agg(w, ' ' ORDER BY place) AS text FROM words ANTI JOIN gone USING (r, place) GROUP BY r),
lost AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(lost.n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (r) LEFT JOIN lost USING (r)"""
