"""N-gram Jaccard self-join by T-occurrence search.

Two texts link when their sets of distinct 5-word shingles have a Jaccard similarity of 0.75 or more, that is, when
they share at least T = ceil(3 (n + m) / 7) shingles. The search finds every link it needs for the classes:

1. Texts with equal sets are one node: the set's 64-bit signature. A second, independent one is compared with it; sets
   that share the first only (some 3 pairs among 10**10 sets) get other nodes, so sets are told apart by 128 bits.
2. Each node posts the first n - ceil(3n/4) + 1 shingles of its set in one global order, rare ones first. Linked nodes
   share a posting. The order comes from a bounded sample of documents; it changes the cost only, never the result. A
   list that the sample shows to be long is dealt out over several parts, anew in each round, so no task holds it.
3. Star rounds contract large groups of near copies without pairing them all: each node is tried against the node that
   is first in most of its inverted lists, then those still apart against a few others of another class. First is decided
   by a hash, for odd seeds weighted by the share of a node's postings that other nodes have too: a copy with few changes
   has the largest share in its group, and copies with many changes link only with such. These rounds look at a share of
   the lists and only save work; step 4 does not rely on what they leave out.
4. Of the pairs that remain in lists that span several classes (whole ones, not parts), all that can still link are searched: sets that share T
   shingles share one of the first n - T + 1 and m - T + 1 of them, in the global order. A query's partners, in blocks of
   at most BLOCK, form an inverted index over the query's shingles, and DivideSkip merges the short lists by a heap, skips
   ahead, and probes the longest lists by binary search.
5. Links become classes by star contraction; a class is named by its smallest doc_id.

No step caps lists, candidates or texts. A text with fewer than five words is one shingle, a text without words (or a
null text) links with nothing and is its own class. Repeated rows with one doc_id are rows of one class if their texts
are; a null doc_id never names a class unless all its doc_ids are null. Empty tables give no rows; other columns are
not read.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollforge.llm.shared import remove, slices, written
from rollforge.llm.textkit import mix, shingle_sets
from rollforge.operators.components import components

K = 5
SAMPLE_DOCS, SAMPLE_DF, MAX_FREQUENT, BLOCK = 32_000, 3, 400_000, 256
#: Rows sent to every task take about ROW_BYTES each there; more than MAX_BROADCAST bytes are shuffled instead.
ROW_BYTES, MAX_BROADCAST = 128, 64 << 20
PART_ROWS, QUERY_PARTS = 50_000, 16
PROBE_WEIGHT = 0.02
STAR_ROUNDS, STAR_SHARE, STAR_LEAST = ([1], [2, 3, 4, 5], [*range(6, 14)], [*range(14, 22)]), 4, 2
CENTRAL = 32
#: Longs of a set's sketch, by the most shingles that a set has for it; the largest sets have none.
SKETCH_LONGS = ((1500, 16), (6000, 64), (25_000, 256))


def needed(n: int, m: int) -> int:
    """Least overlap of linked sets: 100 o >= 75 (n + m - o)."""
    return -(-3 * (n + m) // 7)


def signature(found: np.ndarray, turn: int = 0) -> int:
    """64 bits of a set of shingle hashes, as a signed number; each turn gives others."""
    begun = mix(found ^ np.uint64(0xD6E8FEB86659FD93 * turn & 0xFFFFFFFFFFFFFFFF))
    return int(mix(np.array([np.bitwise_xor.reduce(begun) + np.uint64(len(found))], np.uint64)).view(np.int64)[0])


def node_of(found: np.ndarray, shared: frozenset[int] = frozenset()) -> int:
    """A set's node: its signature, or another one where different sets share that (shared)."""
    first = signature(found)
    return signature(found, 2) if first in shared else first


def sketch_of(found: np.ndarray) -> np.ndarray | None:
    """Which residues an odd number of a set's hashes has, as bits: sets that differ in d shingles differ in d bits at most."""
    longs = next((longs for most, longs in SKETCH_LONGS if len(found) <= most), None)
    if longs is None:
        return None
    odd = np.bincount((found & np.uint64(64 * longs - 1)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def prefix_length(n: int) -> int:
    return n - (3 * n + 3) // 4 + 1


class Order:
    """The global order of shingles: those that are not frequent in the sample by hash, then the others by count."""

    def __init__(self, frequent: np.ndarray, counts: np.ndarray, share: float = 1.0):
        """share: the sample's share of all documents, by which a shingle's list is as long as its count tells."""
        by_hash = np.argsort(frequent)
        self.frequent, self.counts = frequent[by_hash], counts[by_hash]
        self.parts = np.maximum(1, np.ceil(self.counts / share / PART_ROWS)).astype(np.int32) if len(counts) else np.zeros(0, np.int32)

    def parts_of(self, found: np.ndarray) -> np.ndarray:
        """Over how many parts each shingle's list is dealt."""
        if not len(self.frequent):
            return np.ones(len(found), np.int32)
        at = np.searchsorted(self.frequent, found)
        at[at == len(self.frequent)] = 0
        return np.where(self.frequent[at] == found, self.parts[at], 1).astype(np.int32)

    def prefix(self, found: np.ndarray) -> np.ndarray:
        """The first shingles of a set, in the order's sequence."""
        size = prefix_length(len(found))
        if not len(self.frequent):
            return found[:size]
        at = np.searchsorted(self.frequent, found)
        at[at == len(self.frequent)] = 0
        common = self.frequent[at] == found
        rare = found[~common]
        if len(rare) >= size:
            return rare[:size]
        rest, counts = found[common], self.counts[at[common]]
        return np.concatenate([rare, rest[np.lexsort((rest, counts))[: size - len(rare)]]])


def divide_skip(lists: list[list[int]], threshold: int) -> dict[int, int]:
    """Ids that occur on at least threshold of the sorted lists, each with its exact number of lists.

    The longest lists are only probed; a heap merges the others, and after too few hits of the smallest id the lists
    next in line jump ahead to where an id could still collect enough.
    """
    lists = sorted((x for x in lists if x), key=len)
    if len(lists) < threshold or threshold < 1:
        return {}
    longest = len(lists[-1])
    n_long = min(threshold - 1, int(threshold / (PROBE_WEIGHT * np.log2(longest + 1) + 1)))
    short, long_ = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    least, out = threshold - n_long, {}
    heap = [(x[0], i, 0) for i, x in enumerate(short)]
    heapq.heapify(heap)
    while heap:
        top, hits = heap[0][0], []
        while heap and heap[0][0] == top:
            hits.append(heapq.heappop(heap))
        if len(hits) >= least:
            count = len(hits)
            for x in long_:
                at = bisect_left(x, top)
                count += at < len(x) and x[at] == top
            if count >= threshold:
                out[top] = count
            for _, i, place in hits:
                if place + 1 < len(short[i]):
                    heapq.heappush(heap, (short[i][place + 1], i, place + 1))
        else:
            for _ in range(least - 1 - len(hits)):
                if heap:
                    hits.append(heapq.heappop(heap))
            if not heap:
                break
            goal = heap[0][0]
            for _, i, place in hits:
                at = bisect_left(short[i], goal, place)
                if at < len(short[i]):
                    heapq.heappush(heap, (short[i][at], i, at))
    return out


def search(query: np.ndarray, partners: list[np.ndarray]) -> list[tuple[int, int]]:
    """(place, overlap) of the partners that link with the query."""
    wanted = [needed(len(query), len(p)) for p in partners]
    fit = [i for i, p in enumerate(partners) if wanted[i] <= min(len(query), len(p))]
    if not fit or not len(query):
        return []
    lists: list[list[int]] = [[] for _ in range(len(query))]
    for i in fit:
        at = np.searchsorted(query, partners[i])
        at[at == len(query)] = 0
        for j in at[query[at] == partners[i]].tolist():
            lists[j].append(i)
    found = divide_skip(lists, min(wanted[i] for i in fit))
    return [(i, n) for i, n in sorted(found.items()) if n >= wanted[i]]


def row_key(id_col: str, text_col: str) -> Column:
    """What tells rows apart: 64 bits of doc_id and text; either may be null."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))


def document_sets(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, frozenset[int]]:
    """doc_id, row (64 bits of doc_id and text, see row_key), n_shingles, node, sketch as a written table; and the signatures that different sets share."""

    def sets(batches):
        for batch in slices(batches):
            sizes, nodes, checks = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            sketches: list[np.ndarray | None] = [None] * batch.num_rows
            for row, found in shingle_sets(batch.column(1), K):
                sizes[row] = len(found)
                if len(found):
                    nodes[row], checks[row], sketches[row] = signature(found), signature(found, 1), sketch_of(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes), pa.array(nodes), pa.array(checks), pa.array(sketches, pa.list_(pa.int64()))], ["doc_id", "row", "n_shingles", "node", "check", "sketch"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), row_key(id_col, text_col).alias("row"))
    held = written(chosen.mapInArrow(sets, "doc_id long, row long, n_shingles long, node long, check long, sketch array<long>"), "sets")
    clashes = held.where("n_shingles > 0").groupBy("node").agg(F.min("check").alias("low"), F.max("check").alias("high")).where("low <> high").select("node")
    shared = frozenset(r.node for r in clashes.collect())
    return (held.drop("check"), shared) if not shared else (_renamed(held, docs, shared, id_col, text_col), shared)


def _renamed(held: DataFrame, docs: DataFrame, shared: frozenset[int], id_col: str, text_col: str) -> DataFrame:
    """The sets with other nodes for those whose signature is shared: only their texts are read again."""

    def rename(batches):
        for batch in slices(batches):
            nodes = np.zeros(batch.num_rows, np.int64)
            for row, found in shingle_sets(batch.column(1), K):
                nodes[row] = node_of(found, shared) if len(found) else 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes)], ["own_row", "new_node"])

    rows = held.where(F.col("node").isin(list(shared)) & (F.col("n_shingles") > 0)).select(F.col("row").alias("own_row")).distinct()
    texts = docs.select(row_key(id_col, text_col).alias("own_row"), F.col(text_col).cast("string").alias("text"))
    # equal rows have one key and one text
    found = texts.hint("merge").join(rows.hint("merge"), "own_row", "left_semi").mapInArrow(rename, "own_row long, new_node long").distinct()
    joined = held.hint("merge").join(found.hint("merge"), F.col("row") == F.col("own_row"), "left")
    return written(joined.select("doc_id", "row", "n_shingles", F.coalesce("new_node", "node").alias("node"), "sketch"), "sets")


def frequent_shingles(docs: DataFrame, rows: int, id_col: str, text_col: str) -> Order:
    """The order's frequent end, from about SAMPLE_DOCS documents; its length has a fixed bound."""

    def explode(batches):
        for batch in slices(batches, 200):
            found = [s for _, s in shingle_sets(batch.column(0), K)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found) if found else np.zeros(0, np.uint64)).cast(pa.int64(), safe=False)], ["h"])

    step = max(1, rows // SAMPLE_DOCS)
    sample = docs.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(step)) == 0).select(F.col(text_col).cast("string"))
    counts = sample.mapInArrow(explode, "h long").groupBy("h").count().where(F.col("count") >= SAMPLE_DF)
    top = counts.orderBy(F.desc("count"), "h").limit(MAX_FREQUENT).toArrow()
    return Order(top.column("h").to_numpy().view(np.uint64), top.column("count").to_numpy(), 1 / step)


def postings(docs: DataFrame, order: Order, shared_signatures: frozenset[int], text_col: str) -> DataFrame:
    """h, node, n, place, parts: the prefix of every node, numbered; a task posts equal sets once as long as it remembers them."""
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def post(batches):
        seen: set[int] = set()
        for batch in slices(batches):
            shingle, nodes, sizes, lengths = [], [], [], []
            for _, found in shingle_sets(batch.column(0), K):
                if not len(found) or (node := node_of(found, shared_signatures)) in seen:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(node)
                shingle.append(shared.value.prefix(found))
                nodes.append(node)
                sizes.append(len(found))
                lengths.append(len(shingle[-1]))
            flat = np.concatenate(shingle) if shingle else np.zeros(0, np.uint64)
            places = np.concatenate([np.arange(x, dtype=np.int32) for x in lengths]) if lengths else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(np.repeat(np.array(nodes, np.int64), lengths)), pa.array(np.repeat(np.array(sizes, np.int32), lengths)), pa.array(places), pa.array(shared.value.parts_of(flat))], ["h", "node", "n", "place", "parts"])

    return docs.select(F.col(text_col).cast("string")).mapInArrow(post, "h long, node long, n int, place int, parts int")


def _groups(batches) -> Iterator[tuple[int, list[tuple]]]:
    """Rows (query, salt, node, is_query, text) of one query and salt, which come together."""
    key, held = None, []
    for batch in slices(batches):
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:2] != key:
                if held:
                    yield key[0], held
                key, held = row[:2], []
            held.append(row)
    if held:
        yield key[0], held


def may_link(pairs: DataFrame, heads: DataFrame) -> DataFrame:
    """Of pairs (query, node) those that may link, written; all that link are there.

    Linked sets of n and m shingles differ in at most (n + m) / 7 of them, so their sketches differ in no more bits.
    Sets whose sketches are of different lengths, or that have none, stay.
    """
    side = lambda name: heads.select(F.col("node").alias(name), F.col("n").alias(f"{name}_n"), F.col("sketch").alias(f"{name}_sketch")).hint("merge")
    n, m = F.col("query_n"), F.col("node_n")
    both = F.zip_with("query_sketch", "node_sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    bits = F.when(F.size("query_sketch") == F.size("node_sketch"), F.aggregate(both, F.lit(0), lambda total, x: total + x))
    met = pairs.hint("merge").join(side("query"), "query").hint("merge").join(side("node"), "node")
    return written(met.where((n * 4 >= m * 3) & (m * 4 >= n * 3) & F.coalesce(bits * 7 <= n + m, F.lit(True))).select("query", "node"), "near")


def linked(docs: DataFrame, pairs: DataFrame, heads: DataFrame, shared: frozenset[int], id_col: str, text_col: str) -> DataFrame:
    """Of pairs (query, node) those that link, as u, v, written. heads: node, head (the row, as row_key has it, whose text is read for it), n, sketch.

    Only pairs whose sketches leave it open fetch texts.
    """
    pairs = may_link(pairs, heads)
    sizes = written(pairs.groupBy("query").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "sizes")
    # only queries with many partners are looked up, each under QUERY_PARTS keys, so that no task gets all its partners
    large = sizes.where("blocks > 1").select("query", "blocks", F.explode(F.sequence(F.lit(0), F.lit(QUERY_PARTS - 1))).alias("part"))
    parts = pairs.withColumn("part", F.pmod(F.xxhash64("node", F.lit(5)), F.lit(QUERY_PARTS)).cast("int")).hint("merge").join(large.hint("merge"), ["query", "part"], "left")
    parts = parts.select("query", F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1))).cast("int").alias("salt"), "node", F.lit(False).alias("is_query"))
    own = sizes.select("query", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("salt"), F.col("query").alias("node"), F.lit(True).alias("is_query"))
    heads = heads.select(F.col("node").alias("head_node"), "head")
    wanted = written(parts.unionByName(own).hint("merge").join(heads.hint("merge"), F.col("node") == F.col("head_node")).select("query", "salt", "node", "is_query", "head"), "wanted")
    texts = docs.select(row_key(id_col, text_col).alias("own_row"), F.col(text_col).cast("string").alias("text"))
    # few enough rows, counted, are sent to every task so that texts move once; more are joined by shuffling both sides
    few = wanted.count() * ROW_BYTES <= MAX_BROADCAST
    routed = texts.join(F.broadcast(wanted), F.col("own_row") == F.col("head")) if few else texts.hint("merge").join(wanted.hint("merge"), F.col("own_row") == F.col("head"))
    routed = routed.select("query", "salt", "node", "is_query", "text").repartition("query", "salt").sortWithinPartitions("query", "salt", F.desc("is_query"), "node")

    def verify(batches):
        u, v = [], []
        for query, rows in _groups(batches):
            found = [s for _, s in shingle_sets(pa.array([r[4] for r in rows], pa.string()), K)]
            # another row with the same key would bring another text, which has another signature
            nodes = [r[2] if len(s) and node_of(s, shared) == r[2] else None for r, s in zip(rows, found, strict=True)]
            main = next((s for r, s, node in zip(rows, found, nodes, strict=True) if r[3] and node is not None), None)
            if main is None:
                continue
            places = [i for i, (r, node) in enumerate(zip(rows, nodes, strict=True)) if not r[3] and node is not None]
            for i, _ in search(main, [found[p] for p in places]):
                u.append(query)
                v.append(nodes[places[i]])
            if len(u) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
                u, v = [], []
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    links = written(routed.mapInArrow(verify, "u long, v long").distinct(), "links")
    remove(pairs, sizes, wanted)
    return links


def _needed(n: Column, m: Column) -> Column:
    """T of two set sizes, in whole numbers."""
    return F.floor(((n + m) * 3 + 6) / 7).cast("int")


def _posted(n: Column) -> Column:
    """prefix_length in SQL."""
    return n - F.floor((n * 3 + 3) / 4).cast("int") + 1


def _first(seed: int) -> Column:
    """A node's place in the race to be a list's center, the smallest wins; odd seeds favour shared prefixes."""
    even = -F.log((F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(2**40)) + 1) / 2.0**40)
    return even / F.pow(F.col("degree") / _posted(F.col("n")), F.lit(CENTRAL)) if seed % 2 else even


def _part(turn: int) -> Column:
    """The part of its list that a posting is in; every turn deals anew."""
    return F.pmod(F.xxhash64("node", F.lit(turn)), F.col("parts")).cast("int")


def _classed(lists: DataFrame, classes: DataFrame) -> DataFrame:
    return lists.hint("merge").join(classes.hint("merge"), "node")


def _open_lists(lists: DataFrame, classes: DataFrame) -> DataFrame:
    """Postings with their node's class, of lists that span several classes; a list's classes are aggregated before they meet it."""
    named = _classed(lists, classes)
    several = named.groupBy("h").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("h")
    return named.hint("merge").join(several.hint("merge"), "h", "left_semi").select("h", "node", "n", "place", "class").distinct()


def _tries(lists: DataFrame, classes: DataFrame, seeds: list[int]) -> DataFrame:
    """query, node: for each seed the node of another class that comes first in most of a node's lists, if in several."""
    by_list = Window.partitionBy("h", "part")
    named = _classed(lists, classes).withColumn("part", _part(seeds[0]))
    named = named.withColumn("low", F.min("class").over(by_list)).withColumn("high", F.max("class").over(by_list)).where("low <> high")
    firsts = [F.min(F.struct(_first(seed).alias("order"), F.col("node").alias("center"), F.col("class").alias("center_class"))).over(by_list) for seed in seeds]
    seen = named.select("node", "class", F.array(*firsts).alias("firsts")).select("node", "class", F.posexplode("firsts").alias("seed", "first"))
    apart = seen.where(F.col("class") != F.col("first.center_class")).groupBy("node", "seed", F.col("first.center").alias("center")).count()
    best = apart.groupBy("node", "seed").agg(F.max_by("center", F.struct("count", "center")).alias("query"), F.max("count").alias("common"))
    return best.where(F.col("common") >= STAR_LEAST).select("query", "node").distinct()


def _merged(classes: DataFrame, pairs: DataFrame, find) -> DataFrame:
    """Classes after the pairs that link (as find tells): links become bonds of classes, however many there are."""
    if pairs.isEmpty():
        return classes
    links = find(pairs)
    if links.isEmpty():
        return classes
    named = lambda df, side: df.hint("merge").join(classes.select(F.col("node").alias(side), F.col("class").alias(f"{side}_class")).hint("merge"), side).drop(side).withColumnRenamed(f"{side}_class", side)
    bonds = components(named(named(links, "u"), "v").distinct()).select(F.col("node").alias("class"), "component")
    after = written(classes.hint("merge").join(bonds.hint("merge"), "class", "left").select("node", F.coalesce("component", "class").alias("class"), "degree"), "classes")
    remove(classes, links)
    return after


def similarity_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id."""
    return classed_rows(docs, id_col, text_col).select("doc_id", "n_shingles", "component_id")


def classed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """similarity_classes with row, and first: the (doc_id, row) that its class is kept by, null ids last."""
    sets, shared = document_sets(docs, id_col, text_col)
    heads = written(sets.where("n_shingles > 0").groupBy("node").agg(F.min("row").alias("head"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")), "heads")
    order = frequent_shingles(docs, sets.count(), id_col, text_col)
    find = lambda pairs: linked(docs, pairs, heads, shared, id_col, text_col)
    by_list = Window.partitionBy("h", "part")
    lists = postings(docs, order, shared, text_col).withColumn("part", _part(0))
    lists = lists.withColumn("low", F.min("node").over(by_list)).withColumn("high", F.max("node").over(by_list))
    # a list of one node links nothing; of a list in parts every posting stays
    lists = written(lists.where("low <> high or parts > 1").select("h", "node", "n", "place", "parts"), "lists")
    classes = written(lists.groupBy("node").agg(F.col("node").alias("class"), F.count("*").alias("degree")), "classes")
    for seeds in STAR_ROUNDS:
        tries = written(_tries(lists.where(F.pmod(F.col("h"), F.lit(STAR_SHARE)) == 0), classes, seeds), "tries")
        classes = _merged(classes, tries, find)
        remove(tries)
    # lists that span several classes still hold pairs to search
    named = written(_open_lists(lists, classes), "open")
    remove(lists)
    a, b = named.alias("a"), named.alias("b")
    n, m = F.col("a.n"), F.col("b.n")
    needed_ = _needed(n, m)
    meets = (F.col("a.h") == F.col("b.h")) & (F.col("a.class") < F.col("b.class")) & (n * 4 >= m * 3) & (m * 4 >= n * 3)
    meets &= (F.col("a.place") <= n - needed_) & (F.col("b.place") <= m - needed_)
    joined = a.hint("merge").join(b.hint("merge"), meets)
    pairs = written(joined.select(F.col("a.node").alias("query"), F.col("b.node").alias("node")).distinct(), "pairs")
    classes = _merged(classes, pairs, find)
    remove(named, pairs, heads)
    member = sets.where("n_shingles > 0").hint("merge").join(classes.hint("merge"), "node", "left").select("doc_id", "row", "n_shingles", F.coalesce("class", "node").alias("class"))
    member = written(member, "members")
    remove(classes)
    own = F.struct(F.col("doc_id").isNull().alias("is_null"), "doc_id", "row")
    names = member.groupBy("class").agg(F.min("doc_id").alias("component_id"), F.min(own).alias("first"))
    full = member.hint("merge").join(names.hint("merge"), "class").select("doc_id", "row", "n_shingles", "component_id", "first")
    return full.unionByName(sets.where("n_shingles = 0").select("doc_id", "row", "n_shingles", F.col("doc_id").alias("component_id"), own.alias("first")))
