"""The prefix trie of conversations, from sorted neighbours.

Each distinct sequence of turns is a row whose key is 16 bytes a turn (a digest of role and text), so keys in byte order
are the trie's leaves from left to right and the length of the common prefix (LCP) of two neighbours is the depth of the
node that joins them. Keys are dealt out by range. Each part goes through its neighbour edges in descending depth with
union-find: every merge makes a branching node over the merged run of keys, and the nodes between a branching node and
the next one above it have the same members. A part knows the last key before it and the first one after it. Components
that reach over such a boundary stay open: the part's forest is contracted to one row of partial sums for each depth up
to the boundary's LCP, and rows of the same prefix are added up, whatever parts they come from. All sums over a subtree
are sums over its run of keys, so they add up, too.

Texts never move: turns are shuffled as digests and lengths. One conversation's digests (16 bytes a turn, and 4 for the
length) lie in one row, as does what a part holds (about PART_ROWS keys). Copies of one sequence are joined first: their
ids are dealt out by range and come in chunks, and only a chunk at a time is hashed, so a group of copies of any size is
streamed. Keys of equal digests (2**-128) would be taken for equal.

Turns of a conversation are in order of turn, null first; equal ones by their digest. Repeated rows are turns of their
own. A null role or text is empty. Rows with a null conv_id belong to no conversation and are left out. Empty texts have
no bytes to save. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollforge.llm.shared import remove, written

WIDTH = 16
#: Keys of one part, about; a part is what one task holds.
PART_ROWS = 20_000
#: Ids of one chunk of a group of copies.
CHUNK = 4096
SPAN, MOST_SHARED = 5, 9
NONE_SHA = hashlib.sha256(b"").hexdigest()

SEQUENCES = "key binary, sizes array<int>, n long, least long, ends string"
SEQUENCE_KINDS = [pa.binary(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.string()]
CHUNKS = "key binary, sizes array<int>, first_id long, n long, ids string"
NODES = "kind int, part int, depth int, side int, shared binary, up_side int, least long, n long, children long, leaves long, saved long, ends string, up_least long"
NODE_KINDS = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), *[pa.int64()] * 5, pa.string(), pa.int64()]
NODE, OPEN_SUM = 0, 1
LEFT, RIGHT = 0, 1


def sequences(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, key, sizes (the bytes of each text): one row per conversation."""
    role, said = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    mark = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, said)))
    turns = conversations.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.struct(F.col(turn_col).isNotNull().alias("told"), F.col(turn_col).cast("long").alias("turn"), mark.alias("mark"), F.octet_length(said).alias("size")).alias("t"))
    lists = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return lists.select("conv_id", F.unhex(F.array_join(F.transform("t", lambda t: F.hex(t.mark)), "")).alias("key"), F.transform("t", lambda t: t["size"]).alias("sizes"))


def with_shared_heads(convs: DataFrame) -> DataFrame:
    """Each conversation's first turns replaced by those of the first conversation of its span: an edited restart.

    As many turns as crc32 of the id, modulo MOST_SHARED, says; a missing first conversation has none.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED).cast("int")
    own = convs.select("conv_id", "key", "sizes", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % SPAN).alias("first_id"))
    first = convs.where(F.col("conv_id") % SPAN == 0).select(F.col("conv_id").alias("of_id"), F.substring("key", 1, WIDTH * (MOST_SHARED - 1)).alias("head"), F.slice("sizes", 1, MOST_SHARED - 1).alias("head_sizes"))
    both = own.hint("merge").join(first.hint("merge"), F.col("first_id") == F.col("of_id"), "left")
    key = F.concat(F.coalesce(F.expr(f"substring(head, 1, {WIDTH} * h)"), F.lit(b"")), F.expr(f"substring(key, {WIDTH} * h + 1)"))
    none = F.array().cast("array<int>")
    sizes = F.concat(F.coalesce(F.slice("head_sizes", F.lit(1), F.col("h")), none), F.slice("sizes", F.col("h") + 1, F.greatest(F.size("sizes") - F.col("h"), F.lit(0))))
    return both.select("conv_id", key.alias("key"), sizes.alias("sizes"))


def _batch(rows: list[tuple], kinds: list[pa.DataType], schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Runs of equal keys, in order of id, in chunks of ids."""
    held: list[int] = []
    key, sizes = None, None
    row = lambda: (key, sizes, held[0], len(held), ",".join(map(str, held)))
    for batch in batches:
        out = []
        for conv_id, k, s in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if held and (k != key or len(held) == most):
                out.append(row())
                held = []
            if not held:
                key, sizes = k, s
            held.append(conv_id)
        if out:
            yield _batch(out, SEQUENCE_KINDS, CHUNKS)
    if held:
        yield _batch([row()], SEQUENCE_KINDS, CHUNKS)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of one key, in order, as one sequence with the digest of its ids; a chunk at a time is held."""
    key, sizes, n, least, digest = None, None, 0, None, None
    for batch in batches:
        out = []
        for k, s, first, count, ids in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if k != key:
                if digest is not None:
                    out.append((key, sizes, n, least, digest.hexdigest()))
                key, sizes, n, least, digest = k, s, 0, first, hashlib.sha256()
            else:
                digest.update(b",")
            n += count
            digest.update(ids.encode())
        if out:
            yield _batch(out, SEQUENCE_KINDS, SEQUENCES)
    if digest is not None:
        yield _batch([(key, sizes, n, least, digest.hexdigest())], SEQUENCE_KINDS, SEQUENCES)


def distinct_sequences(convs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Each distinct key once: its sizes, how many conversations have it, the least id, and the digest of all their ids."""
    chunks = convs.select("conv_id", "key", "sizes").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").select("conv_id", "key", "sizes")
    chunks = chunks.mapInArrow(partial(_chunks, most=chunk), CHUNKS)
    return chunks.repartition("key").sortWithinPartitions("key", "first_id").mapInArrow(_joined, SEQUENCES)


def _lcp(a: bytes, b: bytes) -> int:
    """Turns that two keys have in common."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // WIDTH
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int((x != y).argmax()) // WIDTH


class Forest:
    """One part: its keys in order, the edges between neighbours, and the edges to the keys just outside (-1: none)."""

    def __init__(self, part: int, left: bytes | None, right: bytes | None, rows: list[tuple[bytes, list[int], int, int, str]]):
        self.part, self.rows, self.n = part, rows, len(rows)
        keys = [left, *(r[0] for r in rows), right]
        # edge i joins key i - 1 with key i
        self.edges = [-1 if a is None or b is None else _lcp(a, b) for a, b in zip(keys, keys[1:], strict=False)]
        self.left, self.right = self.edges[0], self.edges[-1]
        self.sums = [np.concatenate([[0], np.cumsum(np.array(r[1] or [], np.int64))]) for r in rows]
        self.length = [len(r[0]) // WIDTH for r in rows]
        span = range(self.n)
        self.head, self.low, self.high = list(span), list(span), list(span)
        self.count, self.least = [r[2] for r in rows], [r[3] for r in rows]
        self.leaves = [int(self.edges[i + 1] < self.length[i]) for i in span]
        # over a run of keys: bytes of all conversations, less those of the nodes that a key is the first to have
        self.saved = [r[2] * int(self.sums[i][-1]) - int(self.sums[i][-1] - self._before(i)) for i, r in enumerate(rows)]

    def _before(self, i: int) -> int:
        """Bytes of the part of key i that the key before it has, too."""
        return int(self.sums[i][max(self.edges[i], 0)])

    def find(self, i: int) -> int:
        while self.head[i] != i:
            self.head[i] = self.head[self.head[i]]
            i = self.head[i]
        return i

    def union(self, i: int, j: int) -> None:
        """The run of i and the next run, that of j, become one."""
        a, b = self.find(i), self.find(j)
        low, high = self.low[a], self.high[b]
        if high - self.low[b] > self.high[a] - low:
            a, b = b, a
        self.head[b] = a
        self.low[a], self.high[a] = low, high
        self.least[a] = min(self.least[a], self.least[b])
        for sums in (self.count, self.leaves, self.saved):
            sums[a] += sums[b]

    def side(self, c: int, depth: int) -> int | None:
        """Where the node of this run at this depth reaches beyond the part; one that does at both ends counts as LEFT."""
        if self.low[c] == 0 and self.left >= depth:
            return LEFT
        return RIGHT if self.high[c] == self.n - 1 and self.right >= depth else None

    def _saved_from(self, c: int, depth: int, first: bool) -> int:
        """Saved bytes of the run's nodes from depth on; first says whether the node's first key is in this run."""
        low = self.low[c]
        above = int(self.sums[low][max(depth - 1, 0)])
        return self.saved[c] - self.count[c] * above + (above - self._before(low) if first else 0)

    def rows_out(self) -> Iterator[tuple]:
        """Rows of NODES: nodes whose first key lies here, and the partial sums of what is open at each depth."""
        joining, ending = defaultdict(list), defaultdict(list)
        for i in range(1, self.n):
            joining[self.edges[i]].append(i)
        for i, depth in enumerate(self.length):
            ending[depth].append(i)
        reach = max(self.left, self.right)
        waiting: dict[int, list[tuple[int, tuple]]] = defaultdict(list)  # top nodes by the depth of the node above
        for depth in sorted({*joining, *ending, *range(reach + 1)}, reverse=True):
            for i in joining.get(depth, ()):
                self.union(i - 1, i)
            joins: dict[int, int] = defaultdict(int)
            for i in joining.get(depth, ()):
                joins[self.find(i)] += 1
            if depth == self.left:
                joins[self.find(0)] += 1  # the edge over a boundary counts in the part to its right
            for c in dict.fromkeys([*joins, *(self.find(i) for i in ending.get(depth, ()))]):
                if self.side(c, depth) is None:
                    top, rest = self._closed(c, depth, joins.get(c, 0))
                    yield from rest
                    above = max(self.edges[self.low[c]], self.edges[self.high[c] + 1])
                    if above < 0:
                        yield (*top, None)
                    else:
                        waiting[above].append((self.low[c], top))
            for i, top in waiting.pop(depth, ()):
                c = self.find(i)
                side = self.side(c, depth)
                yield (*top[:5], side, *top[6:], self.least[c] if side is None else None)
            for c in dict.fromkeys([self.find(0)] * (self.left >= depth) + [self.find(self.n - 1)] * (self.right >= depth)):
                yield from self._open(c, depth, joins.get(c, 0))

    def _closed(self, c: int, depth: int, joins: int) -> tuple[tuple, list[tuple]]:
        """The node of a run at depth with all nodes above it that have the same members: the top one, and the others."""
        low = self.low[c]
        ended = self.length[low] == depth
        out = []
        for d in range(max(self.edges[low], self.edges[self.high[c] + 1]) + 1, depth + 1):
            children = joins + 1 - ended if d == depth else 1
            ends = self.rows[low][4] if ended and d == depth else NONE_SHA
            out.append((NODE, self.part, d, None, None, None, self.least[c], self.count[c], children, self.leaves[c], self._saved_from(c, d, True), ends))
        return out[0], [(*r, self.least[c]) for r in out[1:]]

    def _open(self, c: int, depth: int, joins: int) -> Iterator[tuple]:
        """The run's sums for the node that reaches beyond the part, and that node itself if its first key is here."""
        low, side = self.low[c], self.side(c, depth)
        first = side == RIGHT
        ended = first and self.length[low] == depth
        shared = hashlib.md5(self.rows[low][0][: WIDTH * depth]).digest()
        yield OPEN_SUM, self.part, depth, side, shared, None, self.least[c], self.count[c], joins - ended, self.leaves[c], self._saved_from(c, depth, first), None, None
        if first:
            # the node above it has this run, too, and is open
            up_side = None if depth == 0 else LEFT if self._reaches_left(c, depth - 1) else RIGHT
            yield NODE, self.part, depth, RIGHT, None, up_side, None, None, None, None, None, self.rows[low][4] if ended else NONE_SHA, None

    def _reaches_left(self, c: int, depth: int) -> bool:
        """Whether the run of c, merged on to this depth (one less than now), is open to the left."""
        return self.left >= depth and min(self.edges[: self.low[c] + 1], default=-1) >= depth


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each part, in order of part and key. A row without a count is a key just outside of the part."""
    now: int | None = None
    left, right, rows = None, None, []

    def grown() -> Iterator[pa.RecordBatch]:
        out = []
        for row in Forest(now, left, right, rows).rows_out() if rows else ():
            out.append(row)
            if len(out) == 10_000:
                yield _batch(out, NODE_KINDS, NODES)
                out = []
        if out:
            yield _batch(out, NODE_KINDS, NODES)

    for batch in batches:
        for part, *row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if part != now:
                yield from grown()
                now, left, right, rows = part, None, None, []
            if row[2] is not None:
                rows.append(tuple(row))
            elif rows:
                right = row[0]
            else:
                left = row[0]
    yield from grown()


def prefix_trie(convs: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """One row for each distinct prefix of the sequences in convs (conv_id, key, sizes), the empty one included.

    conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    seqs = written(distinct_sequences(written(convs, "convs")), "sequences")
    parts = max(1, -(-seqs.count() // part_rows))
    dealt = written(seqs.repartitionByRange(parts, "key").select(F.spark_partition_id().alias("part"), *seqs.columns), "dealt")
    remove(seqs)
    # one row a part that has rows: its neighbours are those before and after it
    order = Window.orderBy("part")
    limits = dealt.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high")).select("part", F.lag("high").over(order).alias("left"), F.lead("low").over(order).alias("right"))
    outside = limits.select("part", F.explode(F.array("left", "right")).alias("key")).where("key is not null")
    outside = outside.select("part", "key", F.lit(None).cast("array<int>").alias("sizes"), *[F.lit(None).cast("long").alias(c) for c in ("n", "least")], F.lit(None).cast("string").alias("ends"))
    grown = dealt.unionByName(outside).repartition("part").sortWithinPartitions("part", "key").mapInArrow(_grow, NODES)
    return _named(written(grown, "nodes"))


def _named(grown: DataFrame) -> DataFrame:
    """Nodes with their sums. Open ones take those of all parts; so do the parents of the nodes below open ones.

    A part's sums for a depth and side are asked for by that part's nodes only, so no key of the joins is hot.
    """
    sums = grown.where(F.col("kind") == OPEN_SUM)
    totals = sums.groupBy("shared", "depth").agg(F.min("least").alias("least"), F.sum("n").alias("n"), (F.sum("children") + 1).alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    asked = sums.select("part", "side", "shared", "depth").hint("merge").join(totals.hint("merge"), ["shared", "depth"])
    asked = written(asked.select("part", "depth", "side", "least", "n", "children", "leaves", "saved"), "open")
    up = asked.select(F.col("part").alias("at_part"), F.col("depth").alias("at_depth"), F.col("side").alias("at_side"), F.col("least").alias("above_least")).hint("merge")
    meets: Column = (F.col("part") == F.col("at_part")) & (F.col("depth") - 1 == F.col("at_depth")) & (F.col("up_side") == F.col("at_side"))
    nodes = grown.where(F.col("kind") == NODE)
    facts = ["part", "depth", "up_side", "least", "n", "children", "leaves", "saved", "ends", "up_least"]
    closed = nodes.where("side is null and up_side is null").select(*facts)
    below = nodes.where("side is null and up_side is not null").select(*facts).hint("merge").join(up, meets).withColumn("up_least", F.col("above_least")).select(*facts)
    own = nodes.where("side is not null").select("part", "depth", "side", "up_side", "ends")
    opened = own.hint("merge").join(asked.hint("merge"), ["part", "depth", "side"]).hint("merge").join(up, meets, "left").withColumn("up_least", F.col("above_least")).select(*facts)
    return closed.unionByName(below).unionByName(opened).select(
        F.col("least").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("up_least").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """The trie of conversations that restart from the first one of their span (with_shared_heads)."""
    return prefix_trie(with_shared_heads(written(sequences(conversations), "turns")), part_rows)


#: Every prefix is a row by its own; ancestors come from the prefixes of one member.
ORACLE = """
    WITH t AS (SELECT conv_id, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS mark, octet_length(encode(coalesce(text, '')))::BIGINT AS size, turn FROM conversations WHERE conv_id IS NOT NULL),
    c AS (SELECT conv_id, list(mark ORDER BY turn NULLS FIRST, mark) AS marks, list(size ORDER BY turn NULLS FIRST, mark) AS sizes FROM t GROUP BY conv_id),
    crc AS (SELECT range AS byte, list_reduce(list_prepend(range::BIGINT, range(8)), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v FROM range(256)),
    table256 AS (SELECT list(v ORDER BY byte) AS vs FROM crc),
    h AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda x, y: xor(x >> 8, vs[(xor(x, y) & 255) + 1])), 4294967295) % 9 AS h FROM c, table256),
    r AS (SELECT c.conv_id, list_concat(coalesce(b.marks, [])[1:h], c.marks[h + 1:]) AS marks, list_concat(coalesce(b.sizes, [])[1:h], c.sizes[h + 1:]) AS sizes
          FROM c JOIN h USING (conv_id) LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 5),
    p AS (SELECT conv_id, len(marks) AS n, d, array_to_string(marks[1:d], '') AS prefix, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size FROM r, LATERAL (SELECT unnest(range(len(marks) + 1)) AS d)),
    v AS (SELECT prefix, d, min(conv_id) AS least, count(*) AS n_convs, any_value(size) AS size, sha256(coalesce(string_agg(CASE WHEN n = d THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends FROM p GROUP BY prefix, d),
    k AS (SELECT substr(prefix, 1, 32 * (d - 1)) AS prefix, count(*) AS n_children FROM v WHERE d > 0 GROUP BY 1),
    a AS (SELECT substr(v.prefix, 1, 32 * u.d) AS prefix, sum((n_convs - 1) * size) AS saved, sum(CASE WHEN k.prefix IS NULL THEN 1 ELSE 0 END) AS n_leaves
          FROM v LEFT JOIN k USING (prefix), LATERAL (SELECT unnest(range(v.d + 1)) AS d) u GROUP BY 1)
    SELECT v.least AS conv_id, v.d AS depth, o.least AS parent_conv_id, v.n_convs, coalesce(k.n_children, 0) AS n_children, a.n_leaves::BIGINT AS n_leaves, a.saved::BIGINT AS saved_tokens, v.ends AS ends_sha256
    FROM v JOIN a USING (prefix) LEFT JOIN k USING (prefix) LEFT JOIN v o ON v.d > 0 AND o.prefix = substr(v.prefix, 1, 32 * (v.d - 1))"""
