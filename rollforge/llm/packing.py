"""Packing token sequences into fixed windows by multiway differencing.

Every task packs the documents of its own input split, so nothing is shuffled. A document is its token ids and one end
id. Whole windows of a long document become sequences of their own. What is left is cut into pieces of at most
max_piece ids; each group of about group_windows windows is dealt by the differencing method of Karmarkar and Karp for
many subsets: the two partial partitions that are most uneven are merged, the fullest subset of one with the emptiest
of the other, until one partition is left. If its fullest subset exceeds the window, the group gets one window more.

Null text counts as empty: one sequence piece with the end id alone. Repeated rows are packed once for each row. Very
long texts only ever hold their own ids in memory. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollforge.llm.shared import slices
from rollforge.llm.tokens import word_bpe

WINDOW, GROUP_WINDOWS, MAX_PIECE, END_ID, SPARE = 2048, 64, 512, 1, 4
BATCH_BYTES = 2 << 20
FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The subset, 0 to k - 1, of each item so that the sums of k subsets are nearly equal."""
    n = len(sizes)
    if k == 1 or n <= 1:
        return np.zeros(n, np.int64)
    parent = np.full(1 + n + n * k, -1, np.int64)
    free = 1 + n
    all_sums, all_sets = np.zeros((n, k), np.int64), np.zeros((n, k), np.int64)
    all_sums[:, 0], all_sets[:, 0] = sizes, np.arange(1, 1 + n)
    heap = [(-size, i, all_sums[i], all_sets[i]) for i, size in enumerate(sizes.tolist())]
    heapq.heapify(heap)
    turn = n
    while len(heap) > 1:
        _, _, sums, sets = heapq.heappop(heap)
        _, _, other, theirs = heap[0]
        sums, mine, theirs = sums + other[::-1], sets, theirs[::-1]
        made = np.arange(free, free + k)
        parent[mine], parent[theirs] = made, made
        parent[0] = -1
        free += k
        order = np.argsort(-sums, kind="stable")
        sums, made = sums[order], made[order]
        heapq.heapreplace(heap, (int(sums[-1] - sums[0]), turn, sums, made))
        turn += 1
    root = np.arange(1, 1 + n)
    while (up := parent[root]).max() >= 0:
        root = np.where(up >= 0, up, root)
    where = {s: i for i, s in enumerate(heap[0][3].tolist())}
    return np.array([where[r] for r in root.tolist()], np.int64)


def dealt(sizes: np.ndarray, window: int) -> tuple[np.ndarray, int]:
    """Subsets that all fit the window, and how many: as few as the total allows, one more as often as one overflows."""
    k = max(1, -(-int(sizes.sum()) // window))
    while True:
        subset = differencing(sizes, k)
        if np.bincount(subset, weights=sizes, minlength=k).max() <= window:
            return subset, k
        k += 1


class Packer:
    """Takes documents, gives finished sequences as rows of FIELDS (and, if asked, each piece's ids)."""

    def __init__(self, window: int, group_windows: int, max_piece: int, first_sequence: int, with_ids: bool):
        self.window, self.max_piece, self.with_ids = window, max_piece, with_ids
        self.target, self.next, self.rows, self.ids = group_windows * (window - SPARE), first_sequence, [], []
        self.waiting: list[tuple[int, int, bytes, int]] = []
        self.total = 0

    def _put(self, doc_id, start: int, piece: bytes, doc_tokens: int, sequence: int, offset: int) -> None:
        self.rows.append((doc_id, start, len(piece) >> 2, zlib.crc32(piece), doc_tokens, sequence, offset))
        if self.with_ids:
            self.ids.append(np.frombuffer(piece, "<u4").astype(np.int32))

    def add(self, doc_id, ids: bytes) -> None:
        n, step = len(ids) >> 2, self.window
        whole = n - n % step
        for start in range(0, whole, step):
            self._put(doc_id, start, ids[4 * start : 4 * (start + step)], n, self.next, 0)
            self.next += 1
        rest = n - whole
        if rest:
            parts = -(-rest // self.max_piece)
            for i in range(parts):
                a, b = whole + rest * i // parts, whole + rest * (i + 1) // parts
                self._wait(doc_id, a, ids[4 * a : 4 * b], n)

    def _wait(self, doc_id, start: int, piece: bytes, n: int) -> None:
        room = self.target - self.total
        if len(piece) >> 2 >= room:
            self.waiting.append((doc_id, start, piece[: 4 * room], n))
            self.flush()
            start, piece = start + room, piece[4 * room :]
        if piece:
            self.waiting.append((doc_id, start, piece, n))
            self.total += len(piece) >> 2

    def flush(self) -> None:
        if not self.waiting:
            return
        sizes = np.array([len(p[2]) >> 2 for p in self.waiting], np.int64)
        subset, k = dealt(sizes, self.window)
        filled = [0] * k
        for (doc_id, start, piece, n), s in zip(self.waiting, subset.tolist(), strict=True):
            self._put(doc_id, start, piece, n, self.next + s, filled[s])
            filled[s] += len(piece) >> 2
        self.next += k
        self.waiting, self.total = [], 0

    def taken(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * len(FIELDS)
        arrays = [pa.array(c, t) for c, (_, t) in zip(columns, FIELDS, strict=True)]
        names = [name for name, _ in FIELDS]
        if self.with_ids:
            arrays.append(pa.array(self.ids, pa.list_(pa.int32())))
            names.append("ids")
        self.rows, self.ids = [], []
        return pa.RecordBatch.from_arrays(arrays, names)


def text_blocks(ids: list, texts: list, size: int = BATCH_BYTES) -> Iterator[tuple[list, list]]:
    """Runs of rows with about size characters."""
    begin, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text or "") + 1
        if held >= size:
            yield ids[begin : i + 1], texts[begin : i + 1]
            begin, held = i + 1, 0
    if begin < len(texts):
        yield ids[begin:], texts[begin:]


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    group_windows: int = GROUP_WINDOWS,
    max_piece: int = MAX_PIECE,
    end_id: int = END_ID,
    vocabulary: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """One row for each piece: its document, place there, length and CRC-32, and its sequence and offset there.

    Sequence ids are unique: the task's partition in the high bits. with_ids adds the ids themselves (array<int>).
    """

    def pack(batches):
        packer = Packer(window, group_windows, max_piece, TaskContext.get().partitionId() << 36, with_ids)
        coder, end = word_bpe(vocabulary), end_id.to_bytes(4, "little")
        for batch in slices(batches):
            for ids, texts in text_blocks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for doc_id, coded in zip(ids, coder.encode(texts), strict=True):
                    packer.add(doc_id, coded + end)
                if len(packer.rows) > 5000:
                    yield packer.taken()
        packer.flush()
        yield packer.taken()

    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(pack, schema)
