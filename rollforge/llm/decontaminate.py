"""Benchmark decontamination by SimHash windows, a multi-index over Hamming blocks, and exact similarity.

Every benchmark item is a multiset of 5-word shingles, weighted by their counts, with a 64-bit SimHash of them. A
document is looked at through windows of an item's own length in words. A window can only be similar if it shares a
shingle with an item, so windows are laid where one occurs, in line with its place in the item; a test holds this against
all windows. Each window's SimHash is looked up in four 16-bit blocks: fingerprints within RADIUS bits differ by at most
RADIUS // 4 bits in some block, so probing every value that near in each block finds all of them. Candidates are what the
index finds, nothing else; each is verified by the exact weighted Jaccard similarity of the two multisets.

A similar window can be further away than RADIUS and is then missed. Of windows of exactly the least similarity, 0.75,
which are the furthest, about one in 10,000 was (tests/llm/test_brute_force.py draws such pairs; recall is at least 0.99).

Items are read in blocks of a bounded size (BLOCK_CHARS), one after the other, so what the driver holds and sends does
not grow with the benchmark; a larger one takes more passes over the documents. Documents never move between tasks.

Words are as in textkit. An item with fewer than five words is one shingle, found as that sequence anywhere; items
without words match nothing, as do documents without words and null texts. Equal items are matched each. Of several
windows of one item in one document the most similar, then the first, is reported; repeated rows are reported each.
Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollforge.llm.shared import slices, written
from rollforge.llm.textkit import blocks, buffers, shingle_stream, short_shingle, words

K, SIMILARITY, RADIUS, PARTS, PART_BITS = 5, 0.75, 23, 4, 16
BLOCK_CHARS = 4_000_000
MAP_BITS = 22
SCHEMA = "doc_id long, item_id long, similarity double, start long, n_words long, distance int"


def gram_stream(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash that a sequence of k words has as an item, from each place on."""
    if k >= K:
        return shingle_stream(hashes, K)
    n = len(hashes) - k + 1
    return np.concatenate([short_shingle(hashes[i : i + k]) for i in range(n)]) if n > 0 else np.zeros(0, np.uint64)


def simhash(found: np.ndarray, counts: np.ndarray) -> int:
    """Each bit is the sign of the counts' sum, plus where the shingle's hash has a one."""
    bits = np.unpackbits(found.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    ones = counts.astype(np.float64) @ bits
    return int.from_bytes(np.packbits(2 * ones > counts.sum()).tobytes(), "big")


def _ball() -> np.ndarray:
    """All 16-bit masks of at most RADIUS // PARTS ones."""
    masks = [sum(1 << b for b in chosen) for r in range(RADIUS // PARTS + 1) for chosen in combinations(range(PART_BITS), r)]
    return np.array(masks, np.int64)


class HammingIndex:
    """Fingerprints by each of their blocks; near() gives all within RADIUS and their distances."""

    def __init__(self, prints: list[int]):
        self.prints = np.array(prints, np.uint64)
        self.ball = _ball()
        self.tables = []
        for part in range(PARTS):
            value = ((self.prints >> np.uint64(part * PART_BITS)) & np.uint64(0xFFFF)).astype(np.int64)
            order = np.argsort(value, kind="stable")
            self.tables.append((order, np.searchsorted(value[order], np.arange((1 << PART_BITS) + 1))))

    def near(self, value: int) -> list[tuple[int, int]]:
        found: set[int] = set()
        for part, (order, starts) in enumerate(self.tables):
            probes = ((value >> (part * PART_BITS)) & 0xFFFF) ^ self.ball
            a, b = starts[probes], starts[probes + 1]
            for x, y in zip(a[b > a].tolist(), b[b > a].tolist(), strict=True):
                found.update(order[x:y].tolist())
        if not found:
            return []
        rows = np.array(sorted(found))
        distance = np.bitwise_count(self.prints[rows] ^ np.uint64(value))
        return [(int(r), int(d)) for r, d in zip(rows, distance, strict=True) if d <= RADIUS]


class Benchmark:
    """The items of one block, ready to be searched for."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        self.ids: list[int] = []
        self.lengths: list[int] = []
        self.counts: list[Counter] = []
        prints, places = [], defaultdict(list)
        for item_id, text in rows:
            raw, offsets = buffers(pa.array([text], pa.string()))
            hashes, _, _, _ = words(raw, offsets)
            if not len(hashes):
                continue
            stream = shingle_stream(hashes, K) if len(hashes) >= K else short_shingle(hashes)
            item = len(self.ids)
            self.ids.append(item_id)
            self.lengths.append(len(hashes))
            self.counts.append(Counter(stream.tolist()))
            found, counts = np.unique(stream, return_counts=True)
            prints.append(simhash(found, counts))
            for offset, h in enumerate(stream.tolist()):
                places[(min(K, len(hashes)), h)].append((item, offset))
        self.index = HammingIndex(prints)
        self.places = {k: dict() for k in {k for k, _ in places}}
        for (k, h), where in places.items():
            self.places[k][h] = where
        self.maps = {}
        for k, known in self.places.items():
            hit = np.zeros(1 << MAP_BITS, bool)
            hit[(np.fromiter(known, np.uint64, len(known)) >> np.uint64(64 - MAP_BITS)).astype(np.int64)] = True
            self.maps[k] = hit

    def matches(self, column: pa.Array) -> Iterator[tuple[int, dict[int, tuple[float, int, int, int]]]]:
        """(row, {item: (similarity, first word, words, distance)}) of the rows with a similar window."""
        if not self.ids:
            return
        raw, offsets = buffers(column)
        for i, j in blocks(offsets):
            hashes, _, _, at = words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            starts: dict[int, set[tuple[int, int]]] = defaultdict(set)
            for k, known in self.places.items():
                stream = gram_stream(hashes, k)
                likely = np.flatnonzero(self.maps[k][(stream >> np.uint64(64 - MAP_BITS)).astype(np.int64)])
                rows = np.searchsorted(at, likely, "right") - 1
                for place, row, h in zip(likely.tolist(), rows.tolist(), stream[likely].tolist(), strict=True):
                    first, last = int(at[row]), int(at[row + 1])
                    if place + k > last:
                        continue
                    for item, offset in known.get(h, ()):
                        size = min(self.lengths[item], last - first)
                        starts[row].add((min(max(first, place - offset), last - size), size))
            for row in sorted(starts):
                best = self._best(hashes, int(at[row]), starts[row])
                if best:
                    yield i + row, best

    def _best(self, hashes: np.ndarray, first: int, windows: set[tuple[int, int]]) -> dict[int, tuple[float, int, int, int]]:
        best: dict[int, tuple[float, int, int, int]] = {}
        for start, size in sorted(windows):
            own = hashes[start : start + size]
            stream = shingle_stream(own, K) if size >= K else short_shingle(own)
            found, counts = np.unique(stream, return_counts=True)
            near = self.index.near(simhash(found, counts))
            held = dict(zip(found.tolist(), counts.tolist(), strict=True)) if near else {}
            for item, distance in near:
                other = self.counts[item]
                both = sum(min(held[h], other[h]) for h in held.keys() & other.keys())
                share = both / (sum(held.values()) + sum(other.values()) - both)
                if share >= SIMILARITY and (item not in best or share > best[item][0]):
                    best[item] = (share, start - first, size, distance)
        return best


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[Benchmark]:
    """The benchmark in blocks of about BLOCK_CHARS characters, each collected on its own."""
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where(F.length("text") > 0)
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // BLOCK_CHARS)
    for i in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect()
        yield Benchmark(sorted(((r.item_id, r.text) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1])))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document and item that has a similar window: where, how similar, and the SimHash distance."""
    spark = docs.sparkSession
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def finder(shared):
        def find(batches):
            for batch in slices(batches):
                ids, rows = batch.column(0), []
                for row, best in shared.value.matches(batch.column(1)):
                    rows += [(ids[row].as_py(), shared.value.ids[item], *found) for item, found in sorted(best.items())]
                columns = list(zip(*rows, strict=True)) or [()] * 6
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

        return find

    passes = []
    for block in item_blocks(benchmark):
        shared = spark.sparkContext.broadcast(block)
        passes.append(written(chosen.mapInArrow(finder(shared), SCHEMA), "leaks"))
        shared.destroy()
    return reduce(DataFrame.unionByName, passes) if passes else spark.createDataFrame([], SCHEMA)


def drop_leaking_rows(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs, unchanged, without a window that is similar to a benchmark item."""
    place = docs.columns.index(text_col)

    def keeper(shared):
        def keep(batches):
            for batch in slices(batches):
                clean = np.ones(batch.num_rows, bool)
                for row, _ in shared.value.matches(batch.column(place)):
                    clean[row] = False
                yield batch.filter(pa.array(clean))

        return keep

    for block in item_blocks(benchmark):
        docs = docs.mapInArrow(keeper(docs.sparkSession.sparkContext.broadcast(block)), docs.schema)
    return docs
