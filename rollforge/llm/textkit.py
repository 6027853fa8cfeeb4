"""Words and word shingles of whole Arrow columns, as 64-bit hashes in numpy.

A word is a longest run of bytes outside 0x20 and 0x09-0x0D after A-Z are lower-cased. A word's hash is a polynomial
of its bytes modulo 2**64 followed by a bit mixer, so equal words have equal hashes and two different words of a pair
of documents collide with a chance of about 2**-64 each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}
_SEEDS = (np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, BLOCK_BYTES + (BLOCK_BYTES >> 1))
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string column; null counts as empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def blocks(offsets: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows with about size bytes each; a longer text is a run of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, start and end byte of every word, and each row's n + 1 word offsets."""
    n = len(raw)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), empty, empty, np.zeros(len(offsets), np.int64)
    low = raw | ((raw - np.uint8(65) < 26).astype(np.uint8) << 5)
    gap = (low == 32) | (low - np.uint8(9) < 5)
    word = ~gap
    first, last = word.copy(), word.copy()
    first[1:] &= gap[:-1]
    last[:-1] &= gap[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    first[edges] |= word[edges]
    last[edges - 1] |= word[edges - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(n)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    found = (sums[end] - sums[begin]) * down[begin]
    found ^= (end - begin).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
    return mix(found), begin, end, np.searchsorted(begin, offsets)


def shingle_stream(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k words from each position on, over a whole block; rows are cut from it by the caller."""
    n = len(word_hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += word_hashes[j : j + n] * _SEEDS[j]
    return mix(total)


def short_shingle(word_hashes: np.ndarray) -> np.ndarray:
    """One hash for a sequence of fewer than k words; none for no words."""
    n = len(word_hashes)
    if n == 0:
        return np.zeros(0, np.uint64)
    length = np.array([n], np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return mix((word_hashes * _SEEDS[:n]).sum(dtype=np.uint64, keepdims=True) + length)


def shingles(column: pa.Array, k: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, hashes in text order with repeats) of every row of a column."""
    raw, offsets = buffers(column)
    for i, j in blocks(offsets):
        own = offsets[i : j + 1] - offsets[i]
        hashes, _, _, at = words(raw[offsets[i] : offsets[j]], own)
        stream = shingle_stream(hashes, k)
        for row in range(j - i):
            a, b = int(at[row]), int(at[row + 1])
            yield i + row, stream[a : b - k + 1] if b - a >= k else short_shingle(hashes[a:b])


def shingle_sets(column: pa.Array, k: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, its sorted distinct shingle hashes) of every row of a column."""
    for row, found in shingles(column, k):
        yield row, np.unique(found)
