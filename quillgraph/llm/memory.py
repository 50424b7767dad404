"""Giving memory back at the end of a task: Python workers live on, and so would what their allocators keep."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa


def trim() -> None:
    """Hands freed pages of Arrow's pool and, where there is one, of the C library's heap back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run: Callable) -> Callable:
    """A function of batches (for mapInArrow) that trims when its task ends."""

    def trimmed(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return trimmed


def lean_group(run: Callable) -> Callable:
    """A function of one group's table (for applyInArrow) that trims when the group is done."""

    def trimmed(table):
        try:
            return run(table)
        finally:
            trim()

    return trimmed
