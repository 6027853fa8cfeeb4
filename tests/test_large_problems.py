"""Problems with very many pairs, and similar sets whose sketches decide, against plain models."""

import random

import pytest
from test_operators import jaccard

from rollforge.operators import clean, pairs
from rollforge.sources import sinks


def shown(rows):
    return sorted((r.problem_id, r.rank, r.c_idx, r.r_idx, round(r.diversity_score, 9)) for r in rows)


@pytest.mark.parametrize("seed,shares", [(1, True), (2, False)])
def test_best_pairs_of_a_large_problem_are_those_of_all_pairs(spark, monkeypatch, seed, shares):
    """With a line that all texts share no pair is disjoint; without one many tie at 1."""
    rng, rows = random.Random(seed), []
    for p in ("big", "small", None):
        for i in range(90 if p == "big" else 8):
            words = [f"{'xy'[i % 2]}{int(rng.paretovariate(0.7))}" for _ in range(rng.choice([0, 3, 10, 40, 200]))]
            text = " ".join(words + ["license", "line"] * (shares and p == "big"))
            rows.append((p, rng.choice([i, i, None]), text, rng.random() < 0.4, rng.choice([0.1, 0.9, None])))
    df = spark.createDataFrame(rows, "problem_id string, sample_idx long, reasoning string, is_correct boolean, confidence double").coalesce(1)
    want = shown(pairs.smart_pair_join(df).collect())
    assert len(want) == 10
    for limit in ("SCORED_PAIRS", "BOUNDED_PER_TASK"):
        monkeypatch.setattr(pairs, limit, 100)
    monkeypatch.setattr(pairs, "FIRST", (2, 2))
    monkeypatch.setattr(pairs, "LARGEST", (2, 3))
    scored, plain = [], pairs._scored
    monkeypatch.setattr(pairs, "_scored", lambda found, *a: scored.append(found.count()) or plain(found, *a))
    assert shown(pairs.smart_pair_join(df).collect()) == want
    good = sum(r[3] for r in rows[:90])
    assert sum(scored) < good * (90 - good) / 4  # most pairs are never scored


def test_only_close_sets_are_fetched(spark, monkeypatch):
    """Texts that share rare words but are not similar do not become candidates."""
    rng, rows = random.Random(3), []
    for i in range(120):
        n = (60, 900, 3000)[i % 3]
        words = [f"rarelongword{i % 3}x{j}" for j in range(n // 5)] + [f"w{rng.randrange(10**6)}" for _ in range(n - n // 5)]
        if i % 12 > 8:  # a near copy of the row before of its size
            words = rows[i - 3][2].split()
            words[: n // 30] = [f"new{i}x{j}" for j in range(n // 30)]
        rows.append(("p", i, " ".join(words)))
    df = spark.createDataFrame(rows, "problem_id string, sample_idx long, reasoning string")
    made, plain = {}, clean.written
    monkeypatch.setattr(clean, "written", lambda found, name: made.setdefault(name, plain(found, name)))
    got = {(r.a_idx, r.b_idx) for r in clean.near_duplicates(df).collect()}
    want = {(a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and jaccard(a[2], b[2]) > 0.85}
    assert got == want and len(want) >= 30
    assert made["pairs"].count() <= 2 * len(want)


def test_words_of_a_set_are_held_once(spark, monkeypatch):
    """A pass keeps words in one table: what sets are found by has none, and small groups are compared in their pass."""
    rng, rows = random.Random(5), []
    for i in range(60):
        words = rows[-1][2].split() if i % 3 else [f"w{rng.randrange(10**6)}" for _ in range(40)]
        words[: 3 * (i % 3)] = [f"new{i}x{j}" for j in range(3 * (i % 3))]
        rows.append(("pq"[i % 2], i, " ".join(words), rng.random()))
    df = spark.createDataFrame(rows, "problem_id string, sample_idx long, reasoning string, confidence double").coalesce(1)
    made, plain = [], clean.written
    monkeypatch.setattr(clean, "written", lambda found, name: made.append((name, found.columns)) or plain(found, name))
    got = {r.sample_idx for r in clean.dedup_greedy(df, 0.6).collect()}
    want = set()
    for p in "pq":
        kept = []
        for row in [r for r in rows if r[0] == p]:
            rival = next((k for k in kept if jaccard(k[2], row[2]) > 0.6), None)
            if rival is None or row[3] > rival[3]:
                kept = [k for k in kept if k is not rival] + [row]
        want |= {k[1] for k in kept}
    assert got == want and len(want) < 60
    assert [name for name, columns in made if "tokens" in columns] == ["samples"]
    assert "links" not in dict(made)


def test_raw_pairs_are_made_only_without_ranked_ones(spark, tmp_path):
    df = spark.createDataFrame([("p", 0, "a b c", True, 0.5), ("p", 1, "d e f", False, 0.5)], "problem_id string, sample_idx long, reasoning string, is_correct boolean, confidence double")
    asked = []
    raw = lambda: asked.append(1) or pairs.pair_join(df)
    for least, times in ((0.2, 0), (2.0, 1)):
        sinks.write_result_bundle(df, df, raw, pairs.smart_pair_join(df, least), df, f"file://{tmp_path}/{times}")
        assert len(asked) == times and spark.read.json(f"file://{tmp_path}/{times}/dpo_pairs").count() == 1


def test_streams_deal_larger_tables_out_over_more_files(spark, tmp_path, monkeypatch):
    """A file of a stream's source does not grow with the table, and the number of turns does not either."""
    from rollforge.plans import streams

    rows = spark.range(4000).selectExpr("id as l_orderkey", "repeat('x', 50) as value")
    spark.conf.set("spark.sql.files.openCostInBytes", "1g")
    try:
        for parts in (1, 6):
            rows.repartition(parts).write.parquet(f"file://{tmp_path}/{parts}/lineitem.parquet")
            monkeypatch.setattr(streams, "new_path", lambda _, name: f"file://{tmp_path}/{parts}/{name}")  # noqa: B023
            stream = streams._source(spark, rows, f"file://{tmp_path}/{parts}")
            query = stream.writeStream.format("parquet").option("path", f"file://{tmp_path}/{parts}/out").option("checkpointLocation", f"file://{tmp_path}/{parts}/at").trigger(availableNow=True).start()
            query.awaitTermination()
            assert len([p for p in query.recentProgress if p["numInputRows"]]) == 2
            assert spark.read.parquet(f"file://{tmp_path}/{parts}/out").count() == 4000
            assert len(spark.read.parquet(f"file://{tmp_path}/{parts}/topic").inputFiles()) == 4 * parts
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_tokenizer_gets_bounded_blocks(spark):
    """However many texts a batch has, a call gets few characters; ids and nulls stay with their rows."""
    from rollforge.functions import hooks

    def make():
        def coded(texts):
            assert len(texts) == 1 or sum(map(len, texts)) <= 500_000
            return [[len(t), len(texts)] for t in texts]

        return coded

    rows = [(i, None if i % 7 == 3 else "x" * (i % 9) * 20_000) for i in range(60)]
    df = spark.createDataFrame(rows, "i long, text string").coalesce(1)
    got = {r.i: r.ids for r in df.select("i", hooks.tokenizer_hook(make)("text").alias("ids")).collect()}
    assert {i: ids and ids[0] for i, ids in got.items()} == {i: None if t is None else len(t) for i, t in rows}
    assert list(hooks._blocks(["a" * 60, "b" * 50, "c" * 300, "", "d"], 100)) == [["a" * 60], ["b" * 50], ["c" * 300], ["", "d"]]
