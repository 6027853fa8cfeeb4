"""The prefix trie, language identification and collocations against plain models, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from rollforge.llm import hyperlang, queries, stripes, trie

TURNS = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def trie_model(rows):
    """Every distinct prefix by itself."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest(), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - int(np.fmod(c, 5)), [])[:h] + own[c][h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
        ends[tuple(ts)].append(c)
    below = Counter(p[:-1] for p in members if p)
    saved, leaves = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1].encode()) if p else 0)
            leaves[p[:d]] += p not in below
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), below[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items()), key=str)


def random_turns(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-30, 400), n):
        said = [(rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", "", None, "long " * 3])) for _ in range(rng.choice([0, 1, 2, 3, 9, 14]))]
        rows += [(c, t if rng.random() < 0.9 else None, *x) for t, x in enumerate(said)]
    rows += [(c, t, "user", "the same") for c in range(1000, 1200) for t in range(12)]
    return rows + [(None, 0, "user", "nobody's"), (5, 1, "user", "twice"), (5, 1, "user", "twice"), (2, None, None, None), (7, 3, "user", "x" * 100_000)]


@pytest.mark.parametrize("part_rows", [1, 3, 17, 20_000])
def test_trie_like_all_prefixes(spark, part_rows):
    rows = random_turns(part_rows)
    df = spark.createDataFrame(rows, TURNS).repartition(5).selectExpr("*", "1 AS key", "'x' AS sizes", "0 AS part")
    assert sorted((tuple(r) for r in trie.conversation_trie(df, part_rows).collect()), key=str) == trie_model(rows)


def test_trie_of_deep_and_turnless_conversations(spark):
    rows = [(c, t, "user", f"{t}" if t < 300 + c else f"{t}-{c}") for c in (10, 15, 20) for t in range(340)] + [(11, 0, "user", "gone")]
    for part_rows in (1, 100):
        got = [tuple(r) for r in trie.conversation_trie(spark.createDataFrame(rows, TURNS), part_rows).collect()]
        assert sorted(got, key=str) == trie_model(rows)
    # crc32("9") % 9 is 4: the only turn goes and 5 is missing, so an empty conversation is left
    assert zlib.crc32(b"9") % 9 > 0
    lone = [tuple(r) for r in trie.conversation_trie(spark.createDataFrame([(9, 0, "user", "hi")], TURNS)).collect()]
    assert lone == [(9, 0, None, 1, 0, 1, 0, hashlib.sha256(b"9").hexdigest())]
    assert trie.conversation_trie(spark.createDataFrame([], TURNS)).count() == 0
    assert trie.conversation_trie(spark.createDataFrame([(None, 0, "user", "x")], TURNS)).count() == 0


def test_a_large_group_of_copies_is_hashed_in_chunks(spark):
    ids = random.Random(1).sample(range(10**6), 500)
    convs = spark.createDataFrame([(c, bytearray(b"k" * 16), [3]) for c in ids], "conv_id long, key binary, sizes array<int>").repartition(6)
    row = trie.distinct_sequences(convs, chunk=7).collect()
    assert [(r.n, r.least, r.ends) for r in row] == [(500, min(ids), hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest())]


def plain_vector(text):
    """All trigrams of all words, one at a time."""
    total = np.zeros(hyperlang.DIM, np.int64)
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        points = [32, *map(ord, word), 32]
        for a, b, c in zip(points, points[1:], points[2:], strict=False):
            va, vb, vc = hyperlang.letter_vectors(np.array([a, b, c]))
            total += np.roll(va, 2).astype(np.int64) * np.roll(vb, 1) * vc
    return total


def test_vectors_of_texts():
    texts = ["The quick brown fox", "", None, "É", "été, Größe! 12 a_b", "zz " * 50, "x" * 40]
    for kept in (20_000, 7):
        old, hyperlang.KEPT = hyperlang.KEPT, kept
        try:
            found, sizes = hyperlang.profiles(texts, hyperlang.Vectors())
        finally:
            hyperlang.KEPT = old
        assert [v.tolist() for v in found] == [plain_vector(t or "").tolist() for t in texts]
        assert sizes.tolist() == [16, 0, 0, 1, 10, 100, 40]
    long = " ".join(random.Random(2).choices(["alpha", "beta", "gamma"], k=120_000))
    once, n = hyperlang.profiles([long], hyperlang.Vectors())
    assert n[0] == len(long.replace(" ", "")) and np.array_equal(once[0], sum(long.split().count(w) * plain_vector(w) for w in ("alpha", "beta", "gamma")))


def test_languages_held_out_and_edge_cases(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame([(None, "and the of", None, None, 0), (900_001, None, "en", "s", 0), (900_002, "", "en", "s", 0), (900_003, "12 !? 34", None, "s", 0), (900_003, "12 !? 34", None, "s", 0), (900_004, "the of and " * 100_000, None, "s", 0)], DOCS)
    both = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(extra).repartition(5).selectExpr("*", "'x' AS lang_pred", "1.0 AS score", "true AS held_out")
    model = hyperlang.train(both)
    got = hyperlang.identify(both, model).collect()
    assert len(got) == both.count() and all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(0.0 <= r.score <= 1.0 for r in got)
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].lang_pred for i in (None, 900_001, 900_002, 900_003, 900_004)] == ["en", "und", "und", "und", "en"] and by_id[900_003].score == 0.0
    lang = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in got if r.held_out and r.doc_id in lang]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
    # prototypes are plain sums, and scores plain cosines
    rows = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.lang == "es"][:3]
    small = hyperlang.train(spark.createDataFrame(rows, docs.schema).repartition(3))
    want = sum(plain_vector(r.text or "") for r in rows)
    assert small.langs == ["es"] and np.allclose(small.prototypes[0], want / np.linalg.norm(want))
    own = plain_vector(rows[0].text)
    score = [r.score for r in hyperlang.identify(spark.createDataFrame(rows[:1], docs.schema), small).collect()]
    assert score == pytest.approx([own @ want / np.linalg.norm(own) / np.linalg.norm(want)])


def test_languages_without_training_rows(spark):
    df = spark.createDataFrame([(1, "some words", None, None, 0)], DOCS)
    assert [(r.lang_pred, r.score) for r in hyperlang.identify(df, hyperlang.train(df)).collect()] == [("und", 0.0)]
    empty = spark.createDataFrame([], DOCS)
    assert hyperlang.identify(empty, hyperlang.train(empty)).count() == 0


def phrases_model(rows, least=30, top=2000):
    counts, n, out = defaultdict(Counter), Counter(), []
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", lowered):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for m in range(1, 5):
                counts[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    for lang, f in counts.items():
        kept = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        scored = []
        for p, a in kept.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and inside(p, q) for q, b in kept.items()):
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def random_texts(seed):
    rng = random.Random(seed)
    word = lambda: rng.choices(["the", "of", "Red", "fox", "jumps", "über", "straße x", "q\x1cq", f"w{rng.randrange(400)}"], [9, 7, 5, 4, 4, 3, 2, 1, 6])[0]
    rows = []
    for _ in range(150):
        parts = [" ".join(word() for _ in range(rng.randrange(12))) + rng.choice([".", ", ", "\n", "\t", " ! ", "\r\n", "  "]) for _ in range(rng.randrange(12))]
        parts.insert(rng.randrange(len(parts) + 1), rng.choice(["", "in the red fox house. ", "New York City Hall; ", "a a a a a a "]))
        rows.append(("".join(parts), rng.choice(["en", "en", "de", None])))
    return rows + [(None, "en"), ("", None), ("many words " * 20_000, "en"), ("...,,,", "fr")] + [("one copy of it", "de")] * 40


@pytest.mark.parametrize("held,hot", [(400_000, 5000), (50, 20)])
def test_collocations_like_a_plain_count(spark, monkeypatch, held, hot):
    monkeypatch.setattr(stripes, "MOST_HELD", held)
    monkeypatch.setattr(stripes, "HOT_SHARE", hot)
    rows = random_texts(held)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(4).selectExpr("*", "'x' AS phrase", "1 AS a", "0 AS slot", "'y' AS prefix")
    want = phrases_model(rows)
    assert sorted(tuple(r) for r in stripes.collocations(df).collect()) == want and len(want) > 20
    top = sorted(tuple(r) for r in stripes.collocations(df, top=3).collect())
    assert top == [r for r in want if r[1] <= 3]


def test_collocations_of_nothing(spark):
    assert stripes.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert stripes.collocations(spark.createDataFrame([(None, None), ("a b", "en")], "text string, lang string")).count() == 0


def block_of(lang, texts):
    return stripes.Block(lang, np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)]))


def test_tables_of_bits(spark):
    texts = [f"w{i} x" for i in range(3000)]
    own, other = block_of("en", texts), block_of("de", texts)
    starts = np.flatnonzero(own.together[1])
    rows = [("en", x) for x in own.rows(2, starts)[0].view(np.int64).tolist()]
    full = stripes.known_phrases(spark.createDataFrame(rows, "lang string, words array<long>").repartition(3), 2)
    assert len(rows) == 3000 and full[own.grams(2)[starts]].all()
    assert full[other.grams(2)[starts]].sum() < 30 and not stripes.Bits({})[own.grams(2)].any()


def test_phrases_stay_in_their_piece_and_stripes_add_up():
    small = block_of("en", ["A b. c\td", "e f", "a  b"])
    rows, counts, at = small.rows(2, np.flatnonzero(small.together[1]))
    assert sorted((small.text(i, 2), n) for i, n in zip(at.tolist(), counts.tolist(), strict=True)) == [("a b", 2), ("c d", 1), ("e f", 1)]
    twice, n = stripes.merged(np.vstack([rows, rows]), np.concatenate([counts, counts]))
    assert sorted(map(tuple, twice.tolist())) == sorted(map(tuple, rows.tolist())) and n.sum() == 2 * counts.sum()
    hot = np.zeros(0, np.uint64)
    same = np.hstack([np.repeat(rows[:1, :1], 50, axis=0), np.arange(50, dtype=np.uint64)[:, None]])
    assert len(set(stripes.shards_of(same, hot, 16).tolist())) == 1
    key = stripes.mix(same[:1, 0] + np.uint64(1))
    assert len(set(stripes.shards_of(same, key, 16).tolist())) > 8 and len(set(stripes.shards_of(same[:, 1:], hot, 16).tolist())) > 8


def test_scores_are_exact_beyond_64_bits(spark):
    big = spark.sql(f"select cast(9000000000000000000 as decimal(20, 0)) * {stripes.SCALE} div (cast(9100000000000000000 as decimal(20, 0)) + cast(9200000000000000000 as decimal(20, 0))) as s").first().s
    assert big == 9 * 10**18 * stripes.SCALE // (91 * 10**17 + 92 * 10**17)


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op13_collocations"])
def test_query_equals_sql(spark, sf_dir, name):
    connection = duckdb.connect()
    for table in ("documents", "conversations"):
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    found = queries.QUERIES[name](spark, sf_dir)
    want = connection.sql(queries.ORACLES[name])
    assert found.columns == want.columns
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(map(str, want.fetchall()))
