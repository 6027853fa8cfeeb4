"""The shared folder's tables, as the library has them, and Arrow batches in small parts."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa

from rollforge.sources.scratch import new_path, remove, written

__all__ = ["give_back", "new_path", "remove", "slices", "written"]


def give_back() -> None:
    """Freed memory goes back to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches in parts of a few rows, so that few texts are Python strings at a time.

    When a task ends its worker lives on for the next one; freed memory goes back to the machine first.
    """
    try:
        for batch in batches:
            for begin in range(0, batch.num_rows, rows):
                yield batch.slice(begin, rows)
    finally:
        give_back()
