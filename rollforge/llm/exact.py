"""Exact de-duplication with a cuckoo index of live digests.

A text's key is the SHA-256 of its UTF-8 bytes. A cuckoo filter keeps a 16-bit fingerprint of each live key in one of
two buckets. A hit is never trusted: the bucket's slot names the stored entry, whose whole digest and byte length are
compared. When no slot can be freed the filter doubles and is filled again from the stored keys. Deleting a key clears
its slot, and only its own.

The corpus is combined twice by the same index: in each input task (so a text that a third of all rows share sends one
row for each task), then in each shard of the digest space.

Null text counts as empty text; all empty texts are one group. doc_id names a row: repeated rows with the same doc_id
and text count in group_size and are listed each, with kept true. Null doc_ids lose to any other; a group of null
doc_ids only has a null keep_id and keeps none. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollforge.llm.shared import written

SLOTS, KICKS, FLUSH = 4, 200, 100_000
GROUP_SCHEMA = "digest binary, n_bytes long, keep_id long, group_size long"


class CuckooIndex:
    """Live digests with a payload; insert, find and delete in constant time."""

    def __init__(self, buckets: int = 256):
        self.keys: list[bytes | None] = []
        self.sizes: list[int] = []
        self.free: list[int] = []
        self.live = 0
        self.resizes = 0
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints = array("H", bytes(2 * SLOTS * buckets))
        self.entries = array("q", bytes(8 * SLOTS * buckets))

    def _places(self, key: bytes) -> tuple[int, int, int]:
        """Fingerprint (never 0) and both buckets. The bits are not those that shards are made of."""
        mark = int.from_bytes(key[8:10], "little") or 1
        first = int.from_bytes(key[16:24], "little") & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ ((mark * 0x5BD1E995) & self.mask)

    def _slot(self, key: bytes, size: int) -> int:
        mark, a, b = self._places(key)
        for bucket in (a, b):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.prints[slot] == mark:
                    entry = self.entries[slot]
                    if self.keys[entry] == key and self.sizes[entry] == size:
                        return slot
        return -1

    def find(self, key: bytes, size: int = 0) -> int:
        """The entry of a live key, verified, or -1."""
        slot = self._slot(key, size)
        return self.entries[slot] if slot >= 0 else -1

    def insert(self, key: bytes, size: int = 0) -> int:
        """The entry of the key, a new one if it was not live."""
        entry = self.find(key, size)
        if entry >= 0:
            return entry
        if self.free:
            entry = self.free.pop()
            self.keys[entry], self.sizes[entry] = key, size
        else:
            entry = len(self.keys)
            self.keys.append(key)
            self.sizes.append(size)
        self.live += 1
        if not self._seat(entry):
            self._grow()
        return entry

    def _seat(self, entry: int) -> bool:
        mark, a, b = self._places(self.keys[entry])
        for bucket in (a, b):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.prints[slot]:
                    self.prints[slot], self.entries[slot] = mark, entry
                    return True
        bucket = b
        for kick in range(KICKS):
            slot = bucket * SLOTS + kick % SLOTS
            self.prints[slot], mark = mark, self.prints[slot]
            self.entries[slot], entry = entry, self.entries[slot]
            bucket = self._other(bucket, mark)
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.prints[slot]:
                    self.prints[slot], self.entries[slot] = mark, entry
                    return True
        return False

    def _grow(self) -> None:
        """Twice the buckets, filled from the stored keys, until all have a seat."""
        buckets = self.mask + 1
        while True:
            buckets *= 2
            self.resizes += 1
            self._clear(buckets)
            if all(self._seat(i) for i, key in enumerate(self.keys) if key is not None):
                return

    def delete(self, key: bytes, size: int = 0) -> int:
        """Clears a live key's slot and gives the entry it had, or -1."""
        slot = self._slot(key, size)
        if slot < 0:
            return -1
        entry = self.entries[slot]
        self.prints[slot] = 0
        self.keys[entry] = None
        self.free.append(entry)
        self.live -= 1
        return entry


def _groups(index: CuckooIndex, best: list, count: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(index.keys, pa.binary()), pa.array(index.sizes, pa.int64()), pa.array(best, pa.int64()), pa.array(count, pa.int64())], ["digest", "n_bytes", "keep_id", "group_size"])


def _combine(batches):
    """Groups of the rows so far; they go out when FLUSH digests are live. A digest's groups may be several."""
    index, best, count = CuckooIndex(), [], []
    for batch in batches:
        for key, size, doc_id, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            entry = index.insert(key, size)
            if entry == len(best):
                best.append(doc_id)
                count.append(n)
            else:
                count[entry] += n
                if doc_id is not None and (best[entry] is None or doc_id > best[entry]):
                    best[entry] = doc_id
        if index.live >= FLUSH:
            yield _groups(index, best, count)
            index, best, count = CuckooIndex(), [], []
    yield _groups(index, best, count)


def _combine_sorted(batches):
    """The same over rows sorted by digest: groups go out between two digests only, so each is complete."""
    index, best, count, last = CuckooIndex(), [], [], None
    for batch in batches:
        for key, size, doc_id, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if index.live >= FLUSH and key != last:
                yield _groups(index, best, count)
                index, best, count = CuckooIndex(), [], []
            last = key
            entry = index.insert(key, size)
            if entry == len(best):
                best.append(doc_id)
                count.append(n)
            else:
                count[entry] += n
                if doc_id is not None and (best[entry] is None or doc_id > best[entry]):
                    best[entry] = doc_id
    yield _groups(index, best, count)


def text_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))


def exact_groups(keys: DataFrame) -> DataFrame:
    """A row for each distinct text: the largest doc_id and the number of rows."""
    rows = keys.select("digest", "n_bytes", "doc_id", F.lit(1).cast("long").alias("n"))
    local = rows.mapInArrow(_combine, GROUP_SCHEMA).select("digest", "n_bytes", "keep_id", "group_size")
    return local.repartition("digest").sortWithinPartitions("digest").mapInArrow(_combine_sorted, GROUP_SCHEMA)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    keys = written(text_keys(docs, id_col, text_col), "keys")
    groups = written(exact_groups(keys), "groups")
    joined = keys.hint("merge").join(groups.hint("merge"), ["digest", "n_bytes"])
    return joined.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def live_digests(events: DataFrame) -> DataFrame:
    """Digests still live after signed events (seq long, op 'insert' or 'delete', digest binary, n_bytes long).

    Each digest's events apply in the order of seq; an insertion of a live digest adds a copy, a deletion takes one, and
    the last copy's deletion takes the digest out of the index. Deletions of digests that are not live do nothing.
    """

    def apply(batches):
        index, copies, last = CuckooIndex(), [], None
        for batch in batches:
            for key, size, op in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if key != last and index.live >= FLUSH:
                    yield survivors(index, copies)
                    index, copies = CuckooIndex(), []
                last = key
                if op == "insert":
                    entry = index.insert(key, size)
                    if entry == len(copies):
                        copies.append(1)
                    else:
                        copies[entry] += 1
                elif op == "delete" and (entry := index.find(key, size)) >= 0:
                    copies[entry] -= 1
                    if not copies[entry]:
                        index.delete(key, size)
        yield survivors(index, copies)

    def survivors(index, copies):
        alive = [i for i, key in enumerate(index.keys) if key is not None]
        return pa.RecordBatch.from_arrays([pa.array([index.keys[i] for i in alive], pa.binary()), pa.array([index.sizes[i] for i in alive], pa.int64()), pa.array([copies[i] for i in alive], pa.int64())], ["digest", "n_bytes", "copies"])

    dealt = events.where("digest is not null").repartition("digest").sortWithinPartitions("digest", "seq")
    return dealt.select("digest", "n_bytes", "op").mapInArrow(apply, "digest binary, n_bytes long, copies long")
