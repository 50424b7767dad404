"""Sorted 64-bit keys with counts packed into bytes, so that a shuffle moves one row per batch and partition.

Spark's row-by-row shuffle of billions of short keys costs more than the keys; here a batch's keys are sorted, cut by
key range into partitions, and sent as delta-coded byte planes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_CODEC = pa.Codec("zstd", compression_level=1)


def pack(values: np.ndarray, sorted_keys: bool = False) -> bytes:
    """An array of unsigned integers as compressed byte planes; ascending ones as differences."""
    if not len(values):
        return b""
    values = np.ascontiguousarray(values)
    kind = values.dtype
    if sorted_keys:
        values = np.diff(values, prepend=np.zeros(1, kind))
    elif kind.itemsize > 1 and values.max() < 256:
        values = values.astype(np.uint8)
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T)
    body = bytearray([values.dtype.itemsize])
    body += len(values).to_bytes(8, "little")
    for plane in planes:
        raw = plane.tobytes()
        small = _CODEC.compress(raw, asbytes=True)
        small, flag = (raw, 0) if len(small) >= len(raw) else (small, 1)
        body += bytes([flag]) + len(small).to_bytes(8, "little") + small
    return bytes(body)


def unpack(blob: bytes, kind, sorted_keys: bool = False) -> np.ndarray:
    if not blob:
        return np.zeros(0, kind)
    width, n, at = blob[0], int.from_bytes(blob[1:9], "little"), 9
    planes = np.empty((width, n), np.uint8)
    for i in range(width):
        flag, size = blob[at], int.from_bytes(blob[at + 1 : at + 9], "little")
        raw = blob[at + 9 : at + 9 + size]
        planes[i] = np.frombuffer(_CODEC.decompress(raw, n, asbytes=True) if flag else raw, np.uint8)
        at += 9 + size
    values = np.ascontiguousarray(planes.T).reshape(-1).view(f"u{width}").astype(kind)
    return np.cumsum(values, dtype=kind) if sorted_keys else values


def edges(parts: int) -> np.ndarray:
    """The first key of each partition but the first."""
    return np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)


def ranges(sorted_keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each partition's keys begin (one more: the end)."""
    return np.concatenate([[0], np.searchsorted(sorted_keys, edges(parts)), [len(sorted_keys)]]).astype(np.int64)


def counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and how often each stands (or the sums of weights)."""
    if weights is None:
        got, n = np.unique(keys, return_counts=True)
        return got, n.astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[start], np.add.reduceat(weights[order], start) if len(start) else np.zeros(0, np.int64)
