"""Whole operators and stages against plain models, and their edge cases."""

import hashlib
import random
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from test_training_data import WORD, LOWER, classes_model, documents, near_texts

from rollforge.llm import chat, decontaminate, ngram_join, packing, quality, queries, rollup, stages, toxicity, urls, warc
from rollforge.llm.tokens import word_bpe

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module", autouse=True)
def by_value():
    """Workers cannot import the tests."""
    cloudpickle.register_pickle_by_value(sys.modules["test_training_data"])


def tuples(text):
    words = WORD.findall((text or "").translate(LOWER))
    return words, [tuple(words[i : i + 5]) for i in range(len(words) - 4)] if len(words) >= 5 else [tuple(words)] if words else []


def all_windows(text, item):
    """The best weighted Jaccard of all item-sized windows of a text."""
    words, _ = tuples(text)
    item_words, grams = tuples(item)
    if not words or not grams:
        return 0.0
    size, best, held = min(len(item_words), len(words)), 0.0, Counter(grams)
    for start in range(len(words) - size + 1):
        own = Counter(tuples(" ".join(words[start : start + size]))[1])
        both = sum((own & held).values())
        best = max(best, both / (sum(own.values()) + sum(held.values()) - both))
    return best


def test_decontamination_like_all_windows(spark):
    rng = random.Random(3)
    word = lambda: f"v{rng.randrange(60)}"
    items = [" ".join(word() for _ in range(rng.choice([3, 5, 12, 30, 45]))) for _ in range(12)] + ["", None, "x y x y x y x y x y"]
    texts = []
    for _ in range(90):
        words = (rng.choice(items) or "").split()
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            if words:
                words[rng.randrange(len(words))] = word()
        texts.append(" ".join([word() for _ in range(rng.randrange(40))] + words + [word() for _ in range(rng.randrange(40))]))
    texts += [None, "", " ".join(word() for _ in range(20_000)) + " " + items[4]]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find_leaks(documents(spark, texts), bench).collect()}
    want = {(d, i): s for d, t in enumerate(texts[:92]) for i, item in enumerate(items) if (s := all_windows(t, item)) >= 0.75}
    assert {k for k in got if k[0] < 92} == set(want) and any(k[0] == 92 for k in got)
    assert all(0.75 <= got[k] <= want[k] + 1e-12 for k in want) and len(want) > 15
    kept = {r.doc_id for r in decontaminate.drop_leaking_rows(documents(spark, texts), bench).collect()}
    assert kept == set(range(93)) - {d for d, _ in got}


def test_token_totals_by_source_language_and_version(spark, sf_dir):
    import public_tokenizers
    import tiktoken

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame([(9001, None, None, None), (9001, "again", None, "s"), (9002, "wide " * 20_000, "en", None)], "doc_id long, text string, lang string, source string")
    docs = docs.select("doc_id", "text", "lang", "source").unionByName(extra)
    words = word_bpe().library
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        import base64

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    pieces = tiktoken.Encoding("model", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = defaultdict(lambda: [0, 0])
    for r in docs.collect():
        for version, n in (("word_bpe_49k", len(words.encode(r.text or "", add_special_tokens=False).ids)), ("byte_bpe_50k", len(pieces.encode_ordinary(r.text or "")))):
            own = want[(r.source, r.lang, version)]
            own[0] += 1
            own[1] += n
    got = {(r.source, r.language, r.version): [r.docs, r.tokens] for r in rollup.rolled_up(docs).collect()}
    assert got == dict(want)


def test_rollup_of_random_batches_like_a_plain_table(spark):
    rng, r, live = random.Random(5), rollup.TokenRollup(spark), []
    schema = "op string, doc_id long, source string, language string, version string, tokens long"
    for batch in range(4):
        rows = [(rng.choice(["insert", "insert", "delete", "revise"]), rng.choice([None, *range(12)]), rng.choice(["a", "b", None]), "en", rng.choice(["v1", "v2"]), rng.randrange(50)) for _ in range(30)]
        assert r.commit(f"b{batch}", spark.createDataFrame(rows, schema))
        gone = {(x[1], x[4]) for x in rows if x[0] != "insert"}
        live = [x for x in live if (x[0], x[3]) not in gone] + [x[1:] for x in rows if x[0] != "delete"]
        want = defaultdict(lambda: [0, 0])
        for _, source, language, version, tokens in live:
            want[(source, language, version)][0] += 1
            want[(source, language, version)][1] += tokens
        assert {(x.source, x.language, x.version): [x.docs, x.tokens] for x in r.totals().collect()} == dict(want)


def test_one_of_two_writers_of_a_batch_counts(spark):
    schema = "op string, doc_id long, source string, language string, version string, tokens long"
    r = rollup.TokenRollup(spark)
    assert r._publish("b1", "first") and not r._publish("b1", "second")
    assert r.batches() == {"b1": "first"}
    r = rollup.TokenRollup(spark)
    r.commit("b1", spark.createDataFrame([("insert", 1, "s", "en", "v", 10)], schema))
    changes = spark.createDataFrame([("revise", 1, "s", "en", "v", 3)], schema)
    read = [p for p in r._removals(changes)._jdf.queryExecution().executedPlan().toString().split("\n") if "PartitionFilters" in p and "bucket" in p]
    assert read and all("bucket" in p.split("PartitionFilters")[1] for p in read)  # only the touched folders are listed


def toxic_model(model, text):
    """The score by slices of characters, n-gram by n-gram."""
    words = (text or "").lower().split()
    n, size = len(words), toxicity.WINDOW
    starts = [0] if n <= size else [*range(0, n - size, size // 2), n - size]
    best = -np.inf
    for s in starts:
        own = " " + " ".join(words[s : s + size] if n > size else words) + " "
        found = set()
        for order in toxicity.ORDERS:
            for i in range(len(own) - order + 1):
                total = sum(ord(c) * int(m) for c, m in zip(own[i : i + order], toxicity._MULTIPLIERS, strict=False)) & 0xFFFFFFFF
                mixed = ((total ^ (0x51ED270B * order & 0xFFFFFFFF)) * 0x9E3779B1) & 0xFFFFFFFF
                mixed ^= mixed >> 15
                found.add(((mixed * 0x2C1B3C6D) & 0xFFFFFFFF) >> (32 - toxicity.BITS))
        best = max(best, sum(float(model.weights[x]) for x in sorted(found)) + model.bias)
    return 1 / (1 + np.exp(-min(30, max(-30, best))))


def test_toxicity_scores_and_stage_like_a_plain_model(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["good", "plain", "word", "vile"] if i % 3 == 0 else ["good", "plain", "word"]) for _ in range(30)) for i in range(120)] + [None, "", "vile " * 700, "É ß " * 200]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, 1, int("vile" in (t or ""))) for i, t in enumerate(texts[:120])], LABELS)
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert len(got) == len(texts) and all(abs(got[i].score - toxic_model(model, t)) < 1e-6 for i, t in enumerate(texts))
    assert all(r.predicted == (r.score >= 0.3) for r in got.values()) and got[122].predicted == 1 and got[120].score == got[121].score
    kept = toxicity.drop_toxic_rows(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.score < 0.3}


def test_quality_scores_like_a_plain_model(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    ranker = quality.train(docs, labels)
    rows, known = docs.collect(), {r.doc_id: r.quality for r in labels.collect()}
    raw = dict(zip([r.doc_id for r in rows], ranker.raw([r.text for r in rows]), strict=True))
    marks = sorted((raw[i], y) for i, y in known.items() if not toxicity.is_held_out(i) and i in raw)
    values, poor = np.array([m for m, _ in marks]), np.mean([y == 0 for _, y in marks])
    place = lambda x: min(len(values) - 1, max(0, round(x * (len(values) - 1))))
    low, high = place(poor - 0.015), place(poor + 0.015)
    k = low + int(np.diff(values[low : high + 1]).argmax()) if high > low else place(poor)
    cut, spread = (values[k] + values[min(len(values) - 1, k + 1)]) / 2, values.std() / 4
    want = {i: 1 / (1 + np.exp(-np.clip((x - cut) / spread + np.log(0.7 / 0.3), -30, 30))) for i, x in raw.items()}
    got = {r.doc_id: r for r in quality.score_quality(docs, labels).collect()}
    assert got.keys() == want.keys() and all(abs(got[i].score - want[i]) < 1e-6 for i in want)
    assert all(r.predicted == (r.score >= 0.7) and r.held_out == toxicity.is_held_out(r.doc_id) for r in got.values())


def test_the_cut_is_an_exact_quantile(spark):
    rng = np.random.default_rng(7)
    raw = rng.normal(size=5000)
    scored = spark.createDataFrame([(i, float(x)) for i, x in enumerate(raw)], "doc_id long, raw double").repartition(6)
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(5000)], LABELS)
    own = np.sort([x for i, x in enumerate(raw) if not toxicity.is_held_out(i)])
    found = quality.with_cut(quality.Ranker(np.zeros(1), np.ones(1), np.ones(1)), scored, labels)
    poor = np.mean([i % 4 == 0 for i in range(5000) if not toxicity.is_held_out(i)])
    assert own[int((poor - 0.02) * len(own))] < found.cut < own[int((poor + 0.02) * len(own))]


def test_features_of_a_text():
    found = quality.features("Ab 12!\nAb cd")
    assert found[0] == 4 / 12 and found[1] == 2 / 12 and found[2] == 2 / 12 and found[8] == 3 / 4 and not quality.features(" \n").any()


def test_ngram_join_tells_sets_apart_that_share_a_signature(spark, monkeypatch):
    texts = near_texts(7, groups=4, copies=8)
    docs = documents(spark, texts)
    real = ngram_join.document_sets
    chosen = []

    def clashing(d, id_col, text_col):
        held, _ = real(d, id_col, text_col)
        chosen.append(held.where("n_shingles > 1").groupBy("node").count().orderBy(F.desc("count"), "node").first().node)
        shared = frozenset(chosen[-1:])
        held = held.withColumn("check", F.lit(0).cast("long"))
        return ngram_join._renamed(held, d, shared, id_col, text_col), shared

    monkeypatch.setattr(ngram_join, "document_sets", clashing)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similarity_classes(docs).collect()}
    assert got == classes_model(texts) and chosen


def test_ngram_join_with_long_lists_in_parts_and_shuffled_partners(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "PART_ROWS", 3)
    monkeypatch.setattr(ngram_join, "MAX_BROADCAST", 0)
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    texts = near_texts(8, groups=3, copies=40)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similarity_classes(documents(spark, texts)).collect()}
    assert got == classes_model(texts)


def test_archives_stay_below_their_size_and_histories_are_in_order(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 4000)
    rng = random.Random(9)
    rows = [(i, f"http://{rng.choice('abc')}.org/{rng.randrange(4)}", "x" * rng.choice([0, 50, 900, 1500, 9000]) + str(i % 7)) for i in range(120)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.capture_histories(df, ranges=5).collect()
    assert sorted(r.position for r in got) == list(range(120)) and len({r.key_range for r in got}) > 1
    order = [(r.url_key, r.captured_at, r.page_id) for r in sorted(got, key=lambda r: r.position)]
    assert order == sorted(order)
    held = defaultdict(list)
    for r in got:
        held[r.run].append(r.payload_bytes if r.record_type == "response" else 0)
    assert len(held) > 10 and all(sum(x) <= 4000 or len(x) == 1 for x in held.values())
    first = {}
    for i, _, html in rows:
        first.setdefault(html, i)
    assert {r.page_id: r.refers_to for r in got} == {i: first[h] if len(h) >= 100 and first[h] != i else None for i, _, h in rows}
    long = spark.createDataFrame([(1, "http://a.org/" + "p" * 100_000, "é" * 3_000_000)], df.schema)
    row = warc.capture_histories(long).first()
    assert row.payload_digest == hashlib.sha256(("é" * 3_000_000).encode()).hexdigest() and row.payload_bytes == 6_000_000


def test_many_rules(spark):
    rng = random.Random(10)
    names = [f"site{i}.example.{rng.choice(['net', 'org'])}/{rng.choice(['', 'en/', 'de/x'])}" for i in range(150)]
    rules = urls.host_rules(names[::2], names[1::2])
    pages = [f"https://www.site{rng.randrange(200)}.example.{rng.choice(['net', 'org'])}/{rng.choice(['en/1', 'de/xy', ''])}" for _ in range(300)] + ["http://site1.example.net/" + "a/" * 50_000]
    got = {r.page_id: r for r in urls.filter_urls(spark.createDataFrame(list(enumerate(pages)), "page_id long, url string"), rules).collect()}
    for i, url in enumerate(pages):
        host, path = urls.parts(url)
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.name), default=None)
        assert (got[i].rule, got[i].verdict) == ((best.name, best.verdict) if best else (None, "allow"))
        assert got[i].n_candidates <= 8


def test_a_conversation_of_equal_turns_comes_in_parts(spark):
    rows = [(1, None, "ann" if i % 2 else "bob", "same") for i in range(600)] + [(1, 5, "system", "x" * 300_000)]
    got = sorted((r for r in chat.perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect() if r.perspective == "ann"), key=lambda r: r.part)
    assert [r.n_turns for r in got] == [256, 256, 89]
    text = "".join(r.text for r in got)
    spans = [s.split("-") for r in got for s in r.spans.split(",") if s]
    assert len(spans) == 300 and {text[int(a) : int(b)] for a, b in spans} == {"same<|im_end|>"}


NAMES = "doc_id long, text string, gone_id long, again_id long, nth_row int, own_row string, doc string, row long, lang string, source string"


def odd(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3, "r", "d", 4, "en", "s") for i, t in rows], NAMES)


@pytest.mark.parametrize("stage", [stages.drop_toxic, stages.drop_copies, stages.drop_near_copies, stages.drop_leaks])
def test_stages_with_clashing_names_nulls_long_texts_and_empty_tables(spark, sf_dir, stage):
    long = " ".join(f"w{i}" for i in range(30_000))
    df = odd(spark, [(1, "a b c d e f"), (2, None), (3, ""), (None, "only here once"), (4, long), (5, "plain words that nobody repeats")])
    got = stage(spark, df, sf_dir)
    assert got.columns == df.columns and got.schema == df.schema
    kept = {(r.doc_id, len(r.text or "")) for r in got.collect()}
    assert {(1, 11), (4, len(long)), (5, 31), (None, 14)} <= kept and {i for i, _ in kept} >= {1, 3, 4, 5}
    twice = stage(spark, odd(spark, [(1, "x y z v w u"), (1, "x y z v w u")]), sf_dir)
    assert twice.count() == (1 if stage in (stages.drop_copies, stages.drop_near_copies) else 2)
    assert stage(spark, odd(spark, []), sf_dir).count() == 0


def test_packing_stage_keeps_every_id(spark, sf_dir):
    df = odd(spark, [(1, "a b c " * 3000), (2, None), (3, ""), (3, ""), (None, "x")])
    rows = stages.pack(spark, df, sf_dir).collect()
    sizes = Counter()
    for r in rows:
        sizes[r.doc_id] += r.length
    coded = [len(x) // 4 + 1 for x in word_bpe().encode(["a b c " * 3000, "", "", "", "x"])]
    assert sizes == {1: coded[0], 2: 1, 3: 2, None: coded[4]}
    held = Counter()
    for r in rows:
        held[r.sequence_id] += r.length
    assert max(held.values()) <= packing.WINDOW


def test_queries_are_all_registered():
    import __spark_entry__

    found = __spark_entry__.queries()
    assert set(queries.QUERIES) | {"pipeline"} <= set(found)
