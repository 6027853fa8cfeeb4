import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rollforge.llm import chat, decontaminate, exact, ngram_join, packing, quality, queries, rollup, toxicity, urls, warc
from rollforge.llm.tokens import word_bpe
from rollforge.operators import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, node long"


def documents(spark, texts, ids=None):
    """Documents with columns whose names the operators use inside, too."""
    rows = [(i, t, "en", "s", len(t or ""), "x", 7) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, DOCS)


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def classes_model(texts):
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


def near_texts(seed, groups=12, copies=12, words=60):
    rng = random.Random(seed)
    out = []
    for _ in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([6, 20, words]))]
        for _ in range(copies):
            t = base[:]
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                t[rng.randrange(len(t))] = f"w{rng.randrange(400)}"
            out.append(" ".join(t))
    return out + ["", None, " \n", "one", "one", "One", "one two", "x y z w v"]


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_like_brute_force(spark, seed):
    texts = near_texts(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similarity_classes(documents(spark, texts)).collect()}
    assert got == classes_model(texts)


def test_ngram_join_without_the_star_rounds_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "STAR_ROUNDS", ())
    texts = near_texts(5, groups=5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similarity_classes(documents(spark, texts)).collect()}
    assert got == classes_model(texts)


def test_ngram_join_of_nothing_and_of_repeated_rows(spark):
    assert ngram_join.similarity_classes(documents(spark, [])).count() == 0
    df = documents(spark, ["a b c d e f", "a b c d e f", "other text of five words"], [3, 3, 3])
    assert [(r.doc_id, r.component_id) for r in ngram_join.similarity_classes(df).collect()] == [(3, 3)] * 3


def test_ngram_join_links_through_rows_with_null_ids(spark):
    base = [f"w{i}" for i in range(60)]
    bridge = " ".join(base)
    left, right = " ".join(["l1", "l2", "l3", "l4", "l5", *base[5:]]), " ".join([*base[:55], "r1", "r2", "r3", "r4", "r5"])
    texts, ids = [left, bridge, right, *(f"{'n ' * 8} {i}" for i in "ab")], [4, None, 7, None, None]
    model = classes_model(texts)
    assert model[0][1] == model[1][1] == model[2][1] and len(shingles(left) & shingles(right)) < 0.75 * len(shingles(left) | shingles(right))
    got = sorted(((r.doc_id, r.component_id) for r in ngram_join.similarity_classes(documents(spark, texts, ids)).collect()), key=str)
    assert got == sorted([(4, 4), (None, 4), (7, 4), (None, None), (None, None)], key=str)


def test_divide_skip_counts_exactly():
    rng = random.Random(3)
    for _ in range(200):
        lists = [sorted(rng.sample(range(40), rng.randrange(0, 25))) for _ in range(rng.randrange(1, 30))]
        threshold = rng.randrange(1, 12)
        counts = Counter(x for held in lists for x in held)
        assert ngram_join.divide_skip(lists, threshold) == {x: n for x, n in counts.items() if n >= threshold}


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)]
    parent = {x: x for pair in links for x in pair}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: find(x) for a, b in links if a != b for x in (a, b)}


def test_exact_dedup_cases(spark):
    texts = ["a", "b", "a", None, "", "A", "b", "é", "x" * 200_000]
    ids = [5, 1, 9, 2, 3, 4, 8, 6, 7]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact.exact_dedup(documents(spark, texts, ids)).collect()}
    groups = defaultdict(list)
    for i, t in zip(ids, texts, strict=True):
        groups[t or ""].append(i)
    want = {i: (max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    assert got == want
    assert exact.exact_dedup(documents(spark, [])).count() == 0


def test_null_ids_never_stay(spark):
    got = exact.exact_dedup(documents(spark, ["a", "a", "b"], [None, 4, None])).collect()
    assert {(r.doc_id, r.keep_id, r.kept) for r in got} == {(None, 4, False), (4, 4, True), (None, None, False)}


def test_cuckoo_index_grows_deletes_and_verifies():
    index, rng = exact.CuckooIndex(buckets=1), random.Random(5)
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    live = {}
    for step in range(9000):
        key = rng.choice(keys)
        if rng.random() < 0.6:
            live[key] = index.insert(key)
        else:
            assert index.delete(key) == live.pop(key, -1)
        if step % 500 == 0:
            assert all((index.find(k) >= 0) == (k in live) for k in keys)
    assert index.live == len(live) and index.resizes > 0
    twin = keys[0][:24] + bytes(8)  # the same fingerprint and buckets, another key
    index.insert(keys[0])
    assert index.find(twin) == -1


def test_live_digests(spark):
    a, b = hashlib.sha256(b"a").digest(), hashlib.sha256(b"b").digest()
    events = [(1, "insert", a, 1), (2, "insert", a, 1), (3, "delete", a, 1), (1, "delete", b, 1), (2, "insert", b, 1), (3, "delete", b, 1)]
    got = exact.live_digests(spark.createDataFrame(events, "seq long, op string, digest binary, n_bytes long")).collect()
    assert [(bytes(r.digest), r.copies) for r in got] == [(a, 1)]


ITEM = "the quick brown fox jumps over the lazy dog while seven wizards quietly brew strong black tea tonight"


def test_decontamination_finds_passages_and_leaves_others(spark):
    filler = " ".join(f"word{i}" for i in range(300))
    changed = ITEM.replace("seven", "eight")
    texts = [f"{filler} {ITEM.upper()} {filler}", ITEM, filler, " ".join(ITEM.split()[:9]), None, "", f"{filler} tiny item", filler + " " + ITEM[:60]]
    bench = spark.createDataFrame([(1, ITEM), (2, "tiny item"), (3, ""), (4, None), (5, " ".join(f"other{i}" for i in range(30)))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find_leaks(documents(spark, texts), bench).collect()}
    assert got == {(0, 1): 1.0, (1, 1): 1.0, (6, 2): 1.0}
    clean = decontaminate.drop_leaking_rows(documents(spark, texts), bench)
    assert sorted(r.doc_id for r in clean.collect()) == [2, 3, 4, 5, 7] and clean.columns == documents(spark, []).columns
    long_item = spark.createDataFrame([(1, filler)], "item_id long, text string")
    altered = filler.replace("word150 ", "changed ")
    found = decontaminate.find_leaks(documents(spark, [altered, changed]), long_item).collect()
    assert [r.doc_id for r in found] == [0] and found[0].similarity > 0.95
    assert decontaminate.find_leaks(documents(spark, []), bench).count() == 0
    assert decontaminate.find_leaks(documents(spark, texts), bench.limit(0)).count() == 0


def test_decontamination_recall_at_the_threshold():
    items = [[f"w{i}x{j}" for j in range(39)] for i in range(3000)]
    texts = [" ".join([*item[:19], "changed", *item[20:]]) for item in items]  # 30 of 35 shingles are left: 30 / 40
    got = {row: found for row, found in decontaminate.Benchmark([(i, " ".join(item)) for i, item in enumerate(items)]).matches(pa.array(texts))}
    assert all({i: f[0] for i, f in found.items()} == {row: 0.75} for row, found in got.items())
    assert len(got) >= 0.999 * len(items) and max(found[row][3] for row, found in got.items()) <= decontaminate.RADIUS


def test_decontamination_finds_nothing_without_its_index(monkeypatch):
    block = decontaminate.Benchmark([(1, ITEM), (2, "tiny item")])
    texts = pa.array([ITEM, f"and {ITEM} and", "a tiny item"])
    assert len(list(block.matches(texts))) == 3
    block.index = decontaminate.HammingIndex([])
    assert not list(block.matches(texts))


def test_a_benchmark_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 200)
    items = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(12)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = documents(spark, [f"some {items[3]} text", "clean", items[11]])
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()} == {(0, 3), (2, 11)}
    assert [r.doc_id for r in decontaminate.drop_leaking_rows(docs, bench).collect()] == [1]


def test_hamming_index_finds_all_within_the_radius():
    rng = random.Random(6)
    prints = [rng.getrandbits(64) for _ in range(300)]
    index = decontaminate.HammingIndex(prints)
    for _ in range(40):
        base = rng.choice(prints)
        for bit in rng.sample(range(64), rng.randrange(0, 24)):
            base ^= 1 << bit
        want = {i: (p ^ base).bit_count() for i, p in enumerate(prints) if (p ^ base).bit_count() <= decontaminate.RADIUS}
        assert dict(index.near(base)) == want


def test_packing_is_whole_gapless_and_tight(spark):
    rng = random.Random(7)
    texts = [" ".join(f"w{rng.randrange(900)}" for _ in range(rng.choice([0, 1, 5, 300, 900, 6000]))) for _ in range(150)] + [None, "", "a" * 20_000]
    df = documents(spark, texts)
    rows = packing.pack_documents(df, with_ids=True).collect()
    coded = {i: np.frombuffer(x, "<u4").tolist() + [1] for i, x in enumerate(word_bpe().encode(texts))}
    places, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) > 0 and r.doc_tokens == len(coded[r.doc_id])
        assert r.ids == coded[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        places[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.start, r.length))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    for i, ids in coded.items():
        at = 0
        for start, length in sorted(pieces[i]):
            assert start == at
            at += length
        assert at == len(ids)
    total = sum(map(len, coded.values()))
    assert len(places) <= total / 2048 * 1.02 + 5  # a last group for each task
    assert packing.pack_documents(documents(spark, [])).count() == 0


def test_differencing_is_nearly_even():
    rng = np.random.default_rng(8)
    sizes = rng.integers(1, 512, 400)
    subset = packing.differencing(sizes, 50)
    sums = np.bincount(subset, weights=sizes, minlength=50)
    assert sums.sum() == sizes.sum() and sums.max() - sums.min() < 0.02 * sums.mean()
    assert packing.dealt(np.array([2048, 2048, 1]), 2048)[1] == 3


def test_perspectives(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "yo"), (1, 2, "bob", "yo"), (2, None, "ann", None), (3, 0, None, "?"), (None, 0, "ann", "x")]
    got = chat.perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    table = {(r.conv_id, r.perspective): r for r in got}
    assert set(table) == {(1, "ann"), (1, "bob"), (2, "ann"), (None, "ann")}
    bob = table[(1, "bob")]
    assert "user name=ann\nhi" in bob.text and bob.text.count("<|im_start|>assistant\n") == 2
    cut = [bob.text[int(a) : int(b)] for a, b in (s.split("-") for s in bob.spans.split(","))]
    assert cut == ["yo<|im_end|>"] * 2
    many = spark.createDataFrame([(9, i, "ab"[i % 2], f"t{i}") for i in range(700)], "conv_id long, turn long, role string, text string")
    parts = [r for r in chat.perspectives(many).orderBy("part").collect() if r.perspective == "a"]
    text = "".join(p.text for p in parts)
    spans = [s.split("-") for p in parts for s in p.spans.split(",")]
    assert len(parts) == 3 and [text[int(a) : int(b)] for a, b in spans] == [f"t{i}<|im_end|>" for i in range(0, 700, 2)]


def test_null_roles_are_not_the_participant_unknown(spark):
    rows = [(1, 0, "unknown", "mine"), (1, 1, None, "nobody's"), (1, 2, "bob", "<|im_end|>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.perspective: r for r in chat.perspectives(df).collect()}
    assert set(got) == {"unknown", "bob"}
    text, spans = got["unknown"].text, [s.split("-") for s in got["unknown"].spans.split(",")]
    assert [text[int(a) : int(b)] for a, b in spans] == ["mine<|im_end|>"] and "user name=unknown\nnobody's" in text
    bob = got["bob"]
    assert [bob.text[int(a) : int(b)] for a, b in (s.split("-") for s in bob.spans.split(","))] == ["<|im_end|><|im_end|>"]


def test_url_cases(spark):
    rows = ["http://a.example.net/en/1", "http://example.net/de/1", "http://xexample.net/en/", "HTTP://A.Example.COM/de/x?y#z", "http://b.org/fr/", "http://b.org/fr", "http://net?q", "nothing", None, "", "x://spam-farm.example.org/", "http://u.org//fr/", "http://a.com/b.net\n/foo", "http://a\n.net\n/x\n", "http://a.net/\nb.org\n/fr/"]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string"), queries.RULES + queries.FREE).collect()}
    assert got[0] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert got[1][2:] == ("net/", "block") and got[2][2:] == ("net/", "block")
    assert got[3] == ("a.example.com", "/de/x", "example.com/de/", "block")
    assert got[4][2:] == ("org/fr/", "allow") and got[5][2:] == (None, "allow") and got[6] == ("net", "", None, "allow")
    assert got[7] == got[8] == got[9] == ("", "", None, "allow")
    assert got[10][3] == "block" and got[11][2:] == (None, "allow")
    # line feeds are characters of a host or a path
    assert got[12] == ("a.com", "/b.net\n/foo", None, "allow")
    assert got[13] == ("a\n.net\n", "/x\n", None, "allow") and got[14] == ("a.net", "/\nb.org\n/fr/", "net/", "block")


def test_rules_are_indexed_by_their_rarest_token():
    rules = urls.host_rules(["example.net/en/"], []) + [urls.free_rule("casino", "casino")]
    assert urls.index_rules(rules, {"example": 9, "net": 5, "en": 7, "casino": 1}) == {"net": [0], "casino": [1]}


def test_warc_round_trip(spark):
    body = "<p>" + "x\r\n\r\nWARC/1.1\r\n" * 20 + "é</p>"
    rows = [(3, "http://b.org/2", body), (1, "http://b.org/1?q#f", body), (2, "http://a.org/\r\nx", body), (4, None, None), (5, "http://a.org/", "tiny"), (6, "http://a.org/", "tiny"), (None, "http://c.org/", body)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.capture_histories(df).collect()
    table = {r.page_id: r for r in got}
    for page_id, _, html in rows:
        r = table[page_id]
        raw = (html or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
    assert {p: (r.record_type, r.refers_to) for p, r in table.items()} == {1: ("response", None), 2: ("revisit", 1), 3: ("revisit", 1), None: ("revisit", 1), 4: ("response", None), 5: ("response", None), 6: ("response", None)}
    order = [(r.url_key, r.captured_at) for r in sorted(got, key=lambda r: r.position)]
    assert order == sorted(order)
    assert warc.capture_histories(df.limit(0)).count() == 0


def test_loser_tree_merges():
    rng = random.Random(9)
    for k in (0, 1, 2, 3, 7, 16):
        runs = []
        for r in range(k):
            runs.append(sorted((("u%d" % rng.randrange(5), "t", rng.randrange(9), 0, "", "", None, f"r{r}", i) for i in range(rng.randrange(0, 12))), key=warc._sort_key))
        got = list(warc.LoserTree(runs))
        assert [warc._sort_key(x) for x in got] == sorted(warc._sort_key(x) for run in runs for x in run)


def test_rollup_batches_commit_once(spark):
    schema = "op string, doc_id long, source string, language string, version string, tokens long"
    r = rollup.TokenRollup(spark)
    totals = lambda: {(x.source, x.language, x.version): (x.docs, x.tokens) for x in r.totals().collect()}
    assert totals() == {}
    first = spark.createDataFrame([("insert", 1, "s", "en", "v", 10), ("insert", 2, "s", "en", "v", 5), ("insert", 3, None, None, "v", 2)], schema)
    assert r.commit("b1", first) and not r.commit("b1", first)
    assert totals() == {("s", "en", "v"): (2, 15), (None, None, "v"): (1, 2)}
    change = spark.createDataFrame([("revise", 1, "t", "en", "v", 12), ("delete", 3, None, None, "v", None), ("delete", 99, "s", "en", "v", 7), ("revise", 4, "t", "en", "v", 1)], schema)
    assert r.commit("b2", change) and not r.commit("b2", change)
    assert totals() == {("s", "en", "v"): (1, 5), ("t", "en", "v"): (2, 13)}
    assert r.commit("b3", spark.createDataFrame([], schema))
    assert totals() == {("s", "en", "v"): (1, 5), ("t", "en", "v"): (2, 13)}
    with pytest.raises(ValueError):
        r.commit("../x", first)


def test_token_counts_like_the_libraries(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    got = {(r.doc_id, r.version): r.tokens for r in rollup.count_tokens(docs).collect()}
    library = word_bpe().library
    for r in docs.collect():
        assert got[(r.doc_id, "word_bpe_49k")] == len(library.encode(r.text, add_special_tokens=False).ids)
    totals = queries.op2_token_counts(spark, sf_dir).groupBy("version").agg(F.sum("docs").alias("d")).collect()
    assert {r.version: r.d for r in totals} == {"byte_bpe_50k": 200, "word_bpe_49k": 200}


@pytest.mark.parametrize(("name", "label", "least"), [("op8_toxicity", "toxic", 0.9), ("op7_quality_classifier", "quality", 0.98)])
def test_held_out_accuracy(spark, name, label, least):
    at = "/root/testdata/sf0.1"
    scored = queries.QUERIES[name](spark, at)
    labels = spark.read.parquet(f"{at}/labels.parquet")
    rows = scored.where("held_out").join(labels, "doc_id").select("predicted", F.col(label).alias("y"), "doc_id").collect()
    assert len(rows) > 500 and all(toxicity.is_held_out(r.doc_id) for r in rows)
    assert np.mean([r.predicted == r.y for r in rows]) >= 0.95
    assert np.mean([r.predicted for r in rows if r.y == 1]) >= least  # a tenth of the larger tables' labels


def test_classifiers_without_labels_or_texts(spark):
    docs = documents(spark, ["fine text", None, "", "x " * 50_000])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    tox = toxicity.score_toxicity(docs, toxicity.train(docs, none)).collect()
    assert all(r.score < 1e-9 and r.predicted == 0 for r in tox) and len(tox) == 4
    good = quality.score_quality(docs, none).collect()
    assert {r.score for r in good} == {0.5}
    empty = documents(spark, [])
    assert toxicity.score_toxicity(empty, toxicity.train(empty, none)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    connection = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf_dir)
    names = sorted(got.columns)
    plain = lambda rows: sorted(str(tuple(None if v is None else bool(v) if isinstance(v, bool) else v for v in r)) for r in rows)
    assert plain(map(tuple, got.select(names).collect())) == plain(connection.sql(queries.ORACLES[name]).select(*names).fetchall())


def test_pipeline_stages_like_brute_force(spark, sf_dir):
    import corpus_pipeline
    from rollforge.llm.shared import written

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = [shingles(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = written(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        after = {r.doc_id for r in docs.collect()}
        assert after <= set(before) and len(after) > 0.7 * len(before)
        if name == "exact_dedup":
            best = {}
            for i, t in before.items():
                best[t] = max(best.get(t, i), i)
            assert after == set(best.values())
        if name == "ngram_join":
            ids = sorted(before)
            model = classes_model([before[i] for i in ids])
            assert after == {ids[i] for i, (_, c) in model.items() if i == c}
        if name == "decontamination":
            gone = set(before) - after
            whole = {i for i, t in before.items() if any(b <= shingles(t) for b in bench)}
            assert whole <= gone
            assert all(any(2 * len(b & shingles(before[i])) >= len(b) for b in bench) for i in gone)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == after


def test_exact_stage_keeps_one_of_identical_rows(spark, sf_dir):
    from rollforge.llm import stages

    df = documents(spark, ["same", "same", "other", "same", "third"], [4, 4, 4, 2, 5])
    assert sorted((r.doc_id, r.text) for r in stages.drop_copies(spark, df, sf_dir).collect()) == [(4, "other"), (4, "same"), (5, "third")]




def test_stages_tell_repeated_and_null_ids_apart(spark, sf_dir):
    from rollforge.llm import stages

    rows = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    df = documents(spark, ["x", "y", "y", "y", "z", "z", "u", None, "", "n"], [5, 5, 9, None, None, None, None, 2, 2, 2])
    got = rows(stages.drop_copies(spark, df, sf_dir))
    assert len(got) == 6 and [r for r in got if r[1]] == sorted([(2, "n"), (5, "x"), (9, "y"), (None, "u"), (None, "z")], key=str)
    base = [f"w{i}" for i in range(60)]
    near, far = [" ".join([*base[:-1], f"e{i}"]) for i in range(4)], [" ".join(f"{c}{i}" for i in range(30)) for c in "abc"]
    df = documents(spark, [near[0], near[1], far[0], near[2], far[1], f"{far[1]} more", far[2], None, None], [3, 5, 5, None, None, None, None, None, None])
    got = rows(stages.drop_near_copies(spark, df, sf_dir))
    assert [r for r in got if r[0] is not None] == sorted([(3, near[0]), (5, far[0])], key=str)
    nulls = [t for i, t in got if i is None]
    assert len(nulls) == 4 and nulls.count(None) == 2 and far[2] in nulls and len({far[1], f"{far[1]} more"} & set(nulls)) == 1
