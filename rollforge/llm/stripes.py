"""Phrase collocations from stripes.

A stripe belongs to a language and a prefix of 0 to 3 words: how often the prefix occurs in all, and a counter of the
words that follow it. A task counts its texts' stripes and hands them on in pieces, each with the stripes of many
prefixes; pieces of the same prefixes are merged elementwise after the shuffle. The merged stripes are one table that
answers all that is asked: entries are the counts of phrases, totals the counts of prefixes, and a stripe's largest entry
is the longest reach of its prefix to the right.

Words are 64-bit hashes in numpy until the end, and a phrase is the list of its words' hashes, so it has 64 bits a word;
two words of one hash would be taken for one. Phrases of 1, 2, 3 and 4 words are counted one length after the other.
Every part of a phrase that occurs LEAST times does so, too, so only phrases whose two parts of one word less are frequent
are looked at. Tasks know the frequent ones of the length before by a bit table of fixed size: what it lets through by
mistake costs time and is counted like the rest, and what is rare in the end is dropped by its exact count. A last pass
reads the texts of the phrases whose score and count may be among a language's first; ties for the last place all stay.

A piece belongs to a shard, by its prefixes' hashes, and the next words' too where a prefix makes up more than one in
HOT_SHARE of all words (there are at most HOT_SHARE of those for a length), or is empty, or begins with such a pair. There
are as many shards as keep one at about SHARD_WORDS words of text, so what a task merges at a time is bounded, and a hot
stripe is spread. Counts of a phrase's parts are the totals of stripes: those of hot parts are broadcast, all others are
joined, where a part has few rows for its few occurrences.

A candidate lies in a longer one with enough of its occurrences only if it does so in one that is longer by one word:
of the two in between, one has at least as many. So the largest count of the phrases that are one word longer, to the
right (a stripe's largest entry) or to the left, decides.

Null texts are empty and a null language is "und". Repeated rows count each. Texts are never cut; a text lies in a row.
An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollforge.llm.shared import remove, slices, written
from rollforge.llm.textkit import blocks, buffers, mix, shingle_stream, words

LEAST, MOST_WORDS, TOP, SCALE, SUBSUMED = 30, 4, 2000, 2_000_000, 80
#: Entries that a task counts before it hands its stripes on.
MOST_HELD = 1_000_000
HOT_SHARE, SHARD_WORDS, KNOWN_BITS, SEGMENTS = 1000, 4_000_000, 25, 32
BLOCK = 1 << 20
#: A-Z to a-z, tab to space, and what ends a piece to a line feed.
TABLE = np.arange(256, dtype=np.uint8)
TABLE[65:91] += 32
TABLE[9] = 32
TABLE[np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8)] = 10
#: Stripes of a shard: rows of word hashes (a prefix and a next word; a prefix and 0 for its total) and their counts.
PIECES = "lang string, shard long, words binary, counts binary"
COUNTS = "lang string, words array<long>, total boolean, n long"


class Bits:
    """A table of 2**KNOWN_BITS bits, asked by the high bits of hashes."""

    shift = np.uint64(64 - KNOWN_BITS)

    def __init__(self, segments: dict[int, bytes]):
        size = (1 << KNOWN_BITS) // 8 // SEGMENTS
        self.held = np.frombuffer(b"".join(segments.get(i, bytes(size)) for i in range(SEGMENTS)), np.uint8)

    def __getitem__(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes >> self.shift).astype(np.int64)
        return (self.held[at >> 3] >> (at & 7).astype(np.uint8)) & np.uint8(1) == 1


def lang_mark(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.md5(lang.encode()).digest()[:8], "little"))


class Block:
    """The words of some texts of one language, and the hashes of all phrases."""

    def __init__(self, lang: str, raw: np.ndarray, offsets: np.ndarray):
        self.lang, self.mark, self.raw = lang, lang_mark(lang), TABLE[raw]
        self.hashes, self.begin, self.end, at = words(self.raw, offsets)
        n = len(self.hashes)
        piece = np.cumsum(self.raw == 10)[self.begin] if n else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        # together[m - 1]: whether the m words from each place on lie in one piece
        self.together = [np.ones(n, bool)]
        after = np.zeros(n, bool)
        if n > 1:
            after[:-1] = (piece[1:] == piece[:-1]) & (row[1:] == row[:-1])
        for m in range(2, MOST_WORDS + 1):
            held = np.zeros(n, bool)
            held[: n - 1] = after[: n - 1] & self.together[-1][1:]
            self.together.append(held)

    def grams(self, m: int) -> np.ndarray:
        """The hash of the m words from each place on; 0 where there are not as many."""
        out = np.zeros(len(self.hashes), np.uint64)
        found = shingle_stream(self.hashes, m) ^ self.mark
        out[: len(found)] = found
        return out

    def frequent(self, m: int, known: list[Bits]) -> np.ndarray:
        """Where a phrase of m words begins that may be frequent, as its parts are."""
        found = np.ones(len(self.hashes), bool)
        for i in range(1, m + 1):
            found = self._grown(found, i)
            found[found] = known[i - 1][self.grams(i)[found]]
        return found

    def _grown(self, part: np.ndarray, m: int) -> np.ndarray:
        """Where a phrase of m words begins whose two parts of one word less are at part."""
        if m == 1:
            return part.copy()
        found = self.together[m - 1] & part
        found[:-1] &= part[1:]
        return found

    def rows(self, m: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The different phrases of m words at these places: a row of word hashes each, how often, and the first place."""
        if not len(places):
            return np.zeros((0, m), np.uint64), np.zeros(0, np.int64), places
        _, first, counts = np.unique(self.grams(m)[places], return_index=True, return_counts=True)
        at = places[first]
        return self.hashes[at[:, None] + np.arange(m)], counts, at

    def stripes(self, m: int, known: list[Bits]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of m word hashes and their counts: the entries of the stripes of m - 1 words, and their totals (last word 0)."""
        part = self.frequent(m - 1, known)
        entries, n, _ = self.rows(m, np.flatnonzero(self._grown(part, m)))
        if m == 1:
            prefixes, totals = np.zeros((1, 0), np.uint64), np.array([len(self.hashes)])
        else:
            prefixes, totals, _ = self.rows(m - 1, np.flatnonzero(part))
        return np.vstack([entries, np.hstack([prefixes, np.zeros((len(prefixes), 1), np.uint64)])]), np.concatenate([n, totals])

    def text(self, place: int, m: int) -> str:
        return b" ".join(self.raw[self.begin[place] : self.end[place + m - 1]].tobytes().split()).decode()


def merged(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal rows once, with the sum of their counts."""
    if not len(rows):
        return rows, counts
    order = np.lexsort(rows.T[::-1])
    rows, counts = rows[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)]))
    return rows[first], np.add.reduceat(counts, first)


def texts_by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Blocks of the rows (lang, text), each of one language."""
    for batch in slices(batches, 4000):
        for lang in pc.unique(batch.column(0)).to_pylist():
            raw, offsets = buffers(batch.column(1).filter(pc.equal(batch.column(0), lang)))
            for i, j in blocks(offsets, BLOCK):
                yield Block(lang, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def known_phrases(counts: DataFrame, m: int) -> Bits:
    """The bits of the phrases (lang, words) of m words in counts: 2**KNOWN_BITS in all, whatever their number."""
    size = (1 << KNOWN_BITS) // SEGMENTS

    def positions(batches):
        for batch in batches:
            held = batch.column(1).flatten().to_numpy().astype(np.int64).view(np.uint64)
            marks = np.array([lang_mark(x) for x in batch.column(0).to_pylist()], np.uint64)
            at = ((shingle_stream(held, m)[::m] ^ marks) >> Bits.shift).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at // size, pa.int32()), pa.array(at % size, pa.int32())], ["segment", "bit"])

    def filled(batches):
        made: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(size, np.uint8))
        for batch in batches:
            segments, bits = (c.to_numpy() for c in batch.columns)
            for segment in np.unique(segments).tolist():
                made[segment][bits[segments == segment]] = 1
        yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.int32()), pa.array([np.packbits(x, bitorder="little").tobytes() for x in made.values()], pa.binary())], ["segment", "bits"])

    rows = counts.select("lang", "words").mapInArrow(positions, "segment int, bit int").repartition(SEGMENTS, "segment").mapInArrow(filled, "segment int, bits binary")
    return Bits({r.segment: bytes(r.bits) for r in rows.collect()})


def shards_of(rows: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    """A prefix's shard; rows of an empty or a hot prefix, or one that begins with a hot pair, go by the next word, too."""
    m = rows.shape[1]
    key = np.zeros(len(rows), np.uint64)
    for i in range(m - 1):
        key = mix(key + rows[:, i] + np.uint64(i + 1))
    begins = key if m < 4 else mix(mix(rows[:, 0] + np.uint64(1)) + rows[:, 1] + np.uint64(2))
    spread = np.ones(len(rows), bool) if m == 1 else np.isin(begins, hot)
    key[spread] = mix(key[spread] + rows[spread, m - 1])
    return (key % np.uint64(shards)).astype(np.int64)


def _hot_keys(table: DataFrame, n: int) -> tuple[DataFrame, np.ndarray]:
    """Totals and entries that make up more than one in HOT_SHARE of n words, at most HOT_SHARE; as rows and as shard keys."""
    found = table.where((F.col("n") > max(LEAST, n // HOT_SHARE)) & ~F.col("total")).collect()
    keys = []
    for r in found:
        key = np.zeros(1, np.uint64)
        for i, w in enumerate(r.words):
            key = mix(key + np.array([w], np.int64).view(np.uint64) + np.uint64(i + 1))
        keys.append(key[0])
    return found, np.array(keys, np.uint64)


def stripes(texts: DataFrame, m: int, known: list[Bits], hot: np.ndarray, shards: int) -> DataFrame:
    """COUNTS of the merged stripes of texts (lang, text) whose prefixes have m - 1 words: entries, and totals without a last word."""
    shared, most = texts.sparkSession.sparkContext.broadcast((known, hot)), MOST_HELD

    def handed_on(lang: str, parts: list[tuple[np.ndarray, np.ndarray]]):
        rows, counts = merged(np.vstack([r for r, _ in parts]), np.concatenate([c for _, c in parts]))
        shard = shards_of(rows, shared.value[1], shards)
        order = np.argsort(shard, kind="stable")
        rows, counts, shard = rows[order], counts[order], shard[order]
        cuts = [*np.flatnonzero(np.diff(shard, prepend=-1)).tolist(), len(shard)]
        for i in range(0, len(cuts) - 1, 1000):
            spans = list(zip(cuts[i : i + 1000], cuts[i + 1 : i + 1001], strict=False))
            columns = [[lang] * len(spans), [int(shard[a]) for a, _ in spans], [rows[a:b].tobytes() for a, b in spans], [counts[a:b].astype(np.int64).tobytes() for a, b in spans]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.int64(), pa.binary(), pa.binary()], strict=True)], ["lang", "shard", "words", "counts"])

    def count(batches):
        known, _ = shared.value
        held: dict[str, list] = defaultdict(list)
        size = 0
        for block in texts_by_lang(batches):
            found = block.stripes(m, known)
            held[block.lang].append(found)
            size += len(found[1])
            if size >= most:
                for lang, parts in held.items():
                    held[lang] = [merged(np.vstack([r for r, _ in parts]), np.concatenate([c for _, c in parts]))]
                size = sum(len(c) for parts in held.values() for _, c in parts)
                if size >= most // 2:
                    for lang, parts in held.items():
                        yield from handed_on(lang, parts)
                    held.clear()
                    size = 0
        for lang, parts in held.items():
            yield from handed_on(lang, parts)

    def of_shard(lang: str, parts: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        rows, n = merged(np.vstack([np.frombuffer(w, np.uint64).reshape(-1, m) for w, _ in parts]), np.concatenate([np.frombuffer(c, np.int64) for _, c in parts]))
        # the empty prefix keeps its total in any case: it is the number of words
        keep = (n >= LEAST) | ((m == 1) & (rows[:, -1] == 0))
        rows, n = rows[keep], n[keep]
        total = rows[:, -1] == 0
        lists = [x[: m - 1] if t else x for x, t in zip(rows.view(np.int64).tolist(), total.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(lists, pa.list_(pa.int64())), pa.array(total), pa.array(n, pa.int64())], ["lang", "words", "total", "n"])

    def merge(batches):
        now, parts = None, []
        for batch in batches:
            for lang, shard, rows, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (lang, shard) != now:
                    if parts:
                        yield of_shard(now[0], parts)
                    now, parts = (lang, shard), []
                parts.append((rows, counts))
        if parts:
            yield of_shard(now[0], parts)

    dealt = texts.mapInArrow(count, PIECES).repartition("lang", "shard").sortWithinPartitions("lang", "shard")
    return written(dealt.mapInArrow(merge, COUNTS), "stripes")


def named(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """lang, words, phrase: the texts of phrases (lang, words) of 2 and more words, from a last pass over the texts."""
    known = {m: known_phrases(phrases.where(F.size("words") == m), m) for m in range(2, MOST_WORDS + 1)}
    shared = texts.sparkSession.sparkContext.broadcast(known)

    def read(batches):
        seen: set[tuple[str, int, int]] = set()
        for block in texts_by_lang(batches):
            lists, said = [], []
            for m, bits in shared.value.items():
                found, grams = block.together[m - 1].copy(), block.grams(m)
                found[found] = bits[grams[found]]
                rows, _, at = block.rows(m, np.flatnonzero(found))
                for row, place, gram in zip(rows.view(np.int64).tolist(), at.tolist(), grams[at].tolist(), strict=True):
                    if (block.lang, m, gram) not in seen:
                        seen.add((block.lang, m, gram))
                        lists.append(row)
                        said.append(block.text(place, m))
            if len(seen) > MOST_HELD:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array([block.lang] * len(said), pa.string()), pa.array(lists, pa.list_(pa.int64())), pa.array(said, pa.string())], ["lang", "words", "phrase"])

    told = texts.mapInArrow(read, "lang string, words array<long>, phrase string").groupBy("lang", "words").agg(F.min("phrase").alias("phrase"))
    return phrases.hint("merge").join(told.hint("merge"), ["lang", "words"])


def _with_counts(asked: DataFrame, counts: DataFrame, hot: list) -> DataFrame:
    """asked (lang, part, ...) with f of each part: hot ones from a broadcast list, the others by a join on the part."""
    listed = asked.sparkSession.createDataFrame([(r.lang, r.words, r.n) for r in hot], "hot_lang string, hot_part array<long>, hot_f long")
    both = written(asked.join(F.broadcast(listed), (F.col("lang") == F.col("hot_lang")) & (F.col("part") == F.col("hot_part")), "left").drop("hot_lang", "hot_part"), "asked")
    rest = both.where(F.col("hot_f").isNull()).drop("hot_f").hint("merge").join(counts.select("lang", F.col("words").alias("part"), F.col("n").alias("f")).hint("merge"), ["lang", "part"])
    return both.where(F.col("hot_f").isNotNull()).withColumnRenamed("hot_f", "f").unionByName(rest)


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases by score, descending, then a, then phrase."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    # at least 16 bytes a shard's word, so that the first pass needs no count
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(16, -(-chars // (4 * SHARD_WORDS)))
    tables = [stripes(texts, 1, [], np.zeros(0, np.uint64), shards)]
    sizes = tables[0].where("total").groupBy("lang").agg(F.sum("n").alias("size"))
    n_words = sizes.agg(F.sum("size")).first()[0] or 0
    hot, keys, known = [], np.zeros(0, np.uint64), []
    for m in range(2, MOST_WORDS + 1):
        more, more_keys = _hot_keys(tables[-1], n_words)
        hot, keys = hot + more, np.concatenate([keys, more_keys])
        known.append(known_phrases(tables[-1].where("not total"), m - 1))
        tables.append(stripes(texts, m, known, keys, shards))
    longer = reduce(DataFrame.unionByName, tables[1:])
    counts, phrases = longer.where("total").drop("total"), longer.where("not total").select("lang", "words", F.col("n").alias("a"))
    # the cut of each phrase that scores lowest
    cuts = phrases.select("lang", "words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    sides = F.explode(F.array(F.struct(F.lit("l").alias("side"), F.slice("words", F.lit(1), F.col("k")).alias("part")), F.struct(F.lit("r").alias("side"), F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")).alias("part"))))
    asked = cuts.select("lang", "words", "a", "k", sides.alias("s")).select("lang", "words", "a", "k", "s.side", "s.part")
    scored = _with_counts(asked, counts, hot).groupBy("lang", "words", "a", "k").agg(F.max(F.when(F.col("side") == "l", F.col("f"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("f"))).alias("r"))
    scored = scored.withColumn("score", F.expr(f"cast(a as decimal(20, 0)) * {SCALE} div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))"))
    scored = scored.groupBy("lang", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # how far a phrase reaches to the right is the largest entry of its own stripe; to the left, the phrases that end in it
    three = phrases.where(F.size("words") > 2)
    ends = [F.slice("words", F.lit(1), F.size("words") - 1), F.slice("words", F.lit(2), F.size("words") - 1)]
    reach = reduce(DataFrame.unionByName, [three.select("lang", e.alias("words"), F.col("a").alias("reach")) for e in ends]).groupBy("lang", "words").agg(F.max("reach").alias("reach"))
    free = F.coalesce(F.col("reach").cast("decimal(20, 0)") * 100 < F.col("a").cast("decimal(20, 0)") * SUBSUMED, F.lit(True))
    # ties for the last place stay until their texts are known
    by_score = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"))
    best = scored.hint("merge").join(reach.hint("merge"), ["lang", "words"], "left").where(free).drop("reach").withColumn("place", F.rank().over(by_score)).where(F.col("place") <= top).drop("place")
    left_over = written(best, "left_over")
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = named(texts, left_over).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    numbered = ranked.hint("merge").join(sizes.hint("merge"), "lang")
    found = written(numbered.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", F.col("size").alias("n"), "cut.score"), "found")
    remove(*tables, left_over)
    return found


ORACLE = """
    WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
    w AS (SELECT row_number() OVER () AS p, lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') AS ws FROM p),
    u AS (SELECT p, lang, unnest(ws) AS w1, generate_subscripts(ws, 1) AS i FROM w),
    x AS (SELECT lang, w1, w1 || ' ' || lead(w1, 1) OVER o AS w2, w1 || ' ' || lead(w1, 1) OVER o || ' ' || lead(w1, 2) OVER o AS w3, w1 || ' ' || lead(w1, 1) OVER o || ' ' || lead(w1, 2) OVER o || ' ' || lead(w1, 3) OVER o AS w4
          FROM u WINDOW o AS (PARTITION BY p ORDER BY i)),
    g AS (SELECT lang, 1 AS m, w1 AS phrase FROM x UNION ALL SELECT lang, 2, w2 FROM x WHERE w2 IS NOT NULL UNION ALL SELECT lang, 3, w3 FROM x WHERE w3 IS NOT NULL UNION ALL SELECT lang, 4, w4 FROM x WHERE w4 IS NOT NULL),
    s AS (SELECT lang, count(*) AS n FROM g WHERE m = 1 GROUP BY lang),
    f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
    c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE m > 1),
    k AS (SELECT c.lang, c.m, c.phrase, c.a, k, x.a AS l, y.a AS r, (2000000::HUGEINT * c.a // (x.a + y.a))::BIGINT AS score
          FROM c, LATERAL (SELECT unnest(range(1, m)) AS k), f x, f y
          WHERE x.lang = c.lang AND x.phrase = array_to_string(ws[1:k], ' ') AND y.lang = c.lang AND y.phrase = array_to_string(ws[k + 1:], ' ')),
    b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM k),
    z AS (SELECT DISTINCT b.lang, b.phrase FROM b JOIN c q ON q.lang = b.lang AND q.m > b.m AND contains(' ' || q.phrase || ' ', ' ' || b.phrase || ' ') AND 100::HUGEINT * q.a >= 80::HUGEINT * b.a WHERE nth = 1),
    o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b WHERE nth = 1 AND NOT EXISTS (SELECT 1 FROM z WHERE z.lang = b.lang AND z.phrase = b.phrase))
    SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN s USING (lang) WHERE rank <= 2000"""
