"""Whole Arrow batches of text as numpy arrays: words, hashes and shingles without a Python loop per word.

A batch's text column is one run of UTF-8 bytes with offsets, so words are found with masks
over all its rows at once and hashed eight bytes at a time, long ones from prefix sums of a polynomial over bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES, CHUNK_BYTES, SHORT_BYTES = 2_000_000, 64_000, 64
#: Numbers mixed at once: few enough to stay in a core's cache.
MIX_AT_ONCE = 1 << 14
_U = np.uint64
_rng = np.random.default_rng(0x51A7)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
#: Masks of the first 0 to 8 bytes of a number.
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], _U)
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _up_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1000)
        for k, base in ((0, _P), (1, _P_INV)):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; equal inputs stay equal, close inputs spread."""
    if h.ndim == 1 and len(h) > MIX_AT_ONCE:
        out = np.empty_like(h)
        for at in range(0, len(h), MIX_AT_ONCE):
            out[at : at + MIX_AT_ONCE] = mix(h[at : at + MIX_AT_ONCE])
        return out
    h = h ^ (h >> _U(32))
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(29)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(32)
    return h


class Bytes:
    """Which bytes are in words, and what stands for each in hashes."""

    def __init__(self, keep, lower: bool = False):
        self.mapped = np.arange(256, dtype=np.uint8)
        if lower:
            self.mapped[65:91] += 32
        self.inside = np.array([keep(int(b)) for b in self.mapped])
        self._tables = self.mapped.tobytes(), self.inside.tobytes()

    def of(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What stands for each byte, and which are in words."""
        raw, (mapped, inside) = data.tobytes(), self._tables
        return np.frombuffer(raw.translate(mapped), np.uint8), np.frombuffer(raw.translate(inside), bool)


#: Words between ASCII white space, as they stand and with A-Z lower-cased.
SPACED = Bytes(lambda b: not (b == 32 or 9 <= b <= 13))
SPACED_LOWER = Bytes(lambda b: not (b == 32 or 9 <= b <= 13), True)
#: Lower-cased runs of 0-9, a-z and everything beyond ASCII.
ALNUM_LOWER = Bytes(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128, True)


def as_binary(column) -> pa.Array:
    """One binary array (null: empty) of any string or binary column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    else:
        column = column.cast(pa.binary())
    return column.fill_null(b"") if column.null_count else column


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows, and where each row begins (one more: the end)."""
    column = as_binary(column)
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    parts = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(parts[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(parts[2], np.uint8)[offsets[0] : offsets[-1]] if parts[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """The batch cut into runs of at most ``rows`` rows and about ``most`` bytes of text (one row at least)."""
    if not batch.num_rows:
        return
    _, offsets = buffers(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        end = min(end, at + rows)
        yield batch.slice(at, end - at)
        at = end


class Words:
    """Words of a run of texts. ``start``/``end``: bytes; ``first``: word index at which each text begins (one more: all)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: Bytes):
        self.data, self.offsets = data, offsets
        self.mapped, self.inside = kind.of(data)
        inside = self.inside
        edge = offsets[(offsets > 0) & (offsets < len(data))]
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        before[edge] = False
        after = np.zeros(len(data), bool)
        after[:-1] = inside[1:]
        after[edge - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        return span_hashes(self.mapped, self.start, self.end)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes; equal bytes give equal hashes anywhere. Spans ascend and do not overlap.

    Spans of up to ``SHORT_BYTES`` are read eight bytes at a time.
    """
    size = end - start
    some = np.flatnonzero(size > SHORT_BYTES)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the number that begins at each byte
    out = mix((eight[start] & _KEEP[np.minimum(size, 8)]) * _U(_P) + size.astype(_U) * _U(0xC2B2AE3D27D4EB4F))
    at = np.flatnonzero((size > 8) & (size <= SHORT_BYTES))
    for done in range(8, SHORT_BYTES, 8):
        at = at[size[at] > done]
        if not len(at):
            break
        out[at] = mix((out[at] ^ eight[start[at] + done] & _KEEP[np.minimum(size[at] - done, 8)]) * _U(_P))
    if len(some):
        out[some] = _long_hashes(data, start[some], end[some])
    return out


def _long_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """As span_hashes, from prefix sums of a polynomial over bytes.

    About ``CHUNK_BYTES`` are worked on at a time, so that memory doesn't follow the length of a text.
    """
    out, i = np.empty(len(start), _U), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(start, start[i] + CHUNK_BYTES)))
        lo, hi = int(start[i]), int(end[j - 1])
        power, inverse = _up_to(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, _U)
        value = np.take(_BYTE, data[lo:hi], mode="clip")
        value *= power[: hi - lo]
        np.cumsum(value, out=sums[1:])
        a, b = start[i:j] - lo, end[i:j] - lo
        out[i:j] = mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(_U) * _U(0xC2B2AE3D27D4EB4F))
        i = j
    return out


_FACTORS = [_U(x) for x in (0x8CB92BA72F3D8DD7, 0xE7037ED1A0B428DB, 0xA0761D6478BD642F, 0x9FB21C651E98DF25, 0xD1342543DE82EF95, 0xF1357AEA2E62A9C5, 0xC5A308D313198A2F, 0xB5026F5AA96619E9)]


def windows(word: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k consecutive words that lie in one text, and the index of the first word of each."""
    n = len(word)
    if n < k:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    h = np.zeros(n - k + 1, _U)
    for i in range(k):
        h += mix(word[i : n - k + 1 + i] * _FACTORS[i % 8] + _U(i))
    left = np.repeat(first[1:], np.diff(first))[: n - k + 1] - np.arange(n - k + 1)
    at = np.flatnonzero(left >= k)
    return mix(h[at]), at


def shingle_sets(words: Words, k: int = 5) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its k-word shingles; with fewer words, of the whole sequence; without words, empty."""
    word = words.hashes()
    h, at = windows(word, words.first, k)
    where = np.searchsorted(at, words.first)
    out = []
    for i in range(len(words.first) - 1):
        a, b = words.first[i], words.first[i + 1]
        if b - a >= k:
            out.append(np.unique(h[where[i] : where[i + 1]]))
        elif b > a:
            whole = np.array([b - a], _U)
            for w in word[a:b]:
                whole = mix(whole * _FACTORS[0] + w)
            out.append(whole)
        else:
            out.append(np.zeros(0, _U))
    return out


def ragged(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array of consecutive runs."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32), pa.int32()), pa.array(values, kind))
