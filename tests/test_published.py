"""Published tables, exact splits, trees by pointer doubling, prefix search, and repeated messages."""

import hashlib
import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rollforge.operators import search, training
from rollforge.sources import publish, sinks
from rollforge.sources.scratch import new_path
from rollforge.streaming import envelopes, pipelines


def test_an_unfinished_attempt_is_never_read(spark):
    root, key, made = new_path(spark, "cache"), {"n": 5}, []
    make = lambda: made.append(1) or spark.range(10)

    def cut_off():
        spark.range(3).write.parquet(f"{path}/attempts/lost")
        raise RuntimeError("gone")

    with pytest.raises(RuntimeError):
        sinks.preference_cache(spark, root, key, lambda: (_ for _ in ()).throw(RuntimeError("gone")))
    path = f"{root}/pairs-{hashlib.sha256(json.dumps(key, sort_keys=True).encode()).hexdigest()[:16]}"
    with pytest.raises(RuntimeError):
        cut_off()
    assert publish.published(spark, path) is None
    for _ in range(2):
        assert sinks.preference_cache(spark, root, key, make).count() == 10
    assert len(made) == 1


def test_the_first_of_two_makers_counts_and_the_last_writer_of_a_step(spark):
    path = new_path(spark, "both")

    def slow(out):
        publish.publish(spark, path, lambda other: spark.range(4).write.parquet(other))  # another maker is done before
        spark.range(9).write.parquet(out)

    assert spark.read.parquet(publish.publish(spark, path, slow)).count() == 4
    steps = new_path(spark, "steps")
    for step, n in ((1, 5), (2, 6), (10, 7), (2, 3)):
        sinks.append_snapshot(spark.range(n), steps, step)
    assert [(r.step, r["count"]) for r in sinks.snapshot(spark, steps, 9).groupBy("step").count().orderBy("step").collect()] == [(1, 5), (2, 3)]
    assert sinks.snapshot(spark, steps, 10).count() == 15
    with pytest.raises(FileNotFoundError):
        sinks.snapshot(spark, steps, 0)


@pytest.mark.parametrize("n,share", [(0, 0.8), (1, 0.8), (7, 0.5), (1000, 0.8), (1003, 0.333), (50, 1.0)])
def test_a_split_is_exact(spark, n, share):
    df = spark.range(n).select((F.col("id") % 600).alias("k"), F.lit("own").alias("h"), F.lit(1).alias("nth")).repartition(5)
    got = training.shuffle_split(df, "k", share, 3)
    assert got.columns == ["k", "h", "nth", "split"]
    assert {r.split: r["count"] for r in got.groupBy("split").count().collect()} == {s: c for s, c in (("train", int(share * n)), ("eval", n - int(share * n))) if c}
    place = lambda k: (hashlib.md5(f"3:{k}".encode()).hexdigest(), k)
    assert sorted(r.k for r in got.where("split = 'train'").collect()) == sorted(sorted((r.k for r in df.collect()), key=place)[: int(share * n)])


def test_a_sample_of_rows_with_one_key(spark):
    df = spark.range(500).select(F.lit(None).cast("string").alias("k"), "id").repartition(4)
    found = training.sample_problems(df, "k", 123, 1)
    assert found.count() == 123 and found.select("id").distinct().count() == 123 and training.sample_problems(df, "k", 900, 1).count() == 500


def tree_model(rows):
    up = {n: p for n, p, _, _ in rows}
    out = defaultdict(lambda: [0, 0.0])
    for n, _, visits, value in rows:
        path, at = [], n
        while at is not None and at in up and at not in path:
            path.append(at)
            at = up[at]
        if at is None:
            for a in path:
                out[a][0] += visits
                out[a][1] += value
    return {n: (v, round(s, 6)) for n, (v, s) in out.items()}


def test_trees_of_any_shape(spark):
    rng = random.Random(4)
    rows = [(i, None if i < 4 else rng.randrange(i), rng.randrange(5), rng.random()) for i in range(300)]
    rows += [(1000, 2000, 1, 1.0), (1001, 1000, 1, 1.0), (3000, 3001, 1, 1.0), (3001, 3000, 1, 1.0), (3002, 3001, 1, 1.0)]  # an orphan and a circle
    rows += [(5000 + i, 0, 1, 0.5) for i in range(400)]  # one hot parent
    df = spark.createDataFrame(rows, "node_id long, parent_id long, visits long, value double").withColumn("problem_id", F.lit("p"))
    assert {r.node_id: (r.visits, round(r.value, 6)) for r in search.reward_by_node(df).collect()} == tree_model(rows)


def test_a_chain_takes_as_many_rounds_as_its_depth_has_bits(spark, monkeypatch):
    names, written = [], search.written
    monkeypatch.setattr(search, "written", lambda df, name: names.append(name) or written(df, name))
    df = spark.range(700).select(F.lit(1).alias("problem_id"), F.col("id").alias("node_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"), F.lit(1).alias("visits"), F.lit(1.0).alias("value"))
    assert {r.node_id: r.visits for r in search.reward_by_node(df).collect()} == {i: 700 - i for i in range(700)}
    assert len(names) - 1 == 10
    with pytest.raises(ValueError):
        search.reward_by_node(df.limit(20), max_depth=5)


def test_longest_prefixes_like_brute_force(spark):
    rng = random.Random(9)
    seq = lambda most: [rng.randrange(3) for _ in range(rng.randrange(most))]
    stored = [seq(9) for _ in range(150)] + [list(range(100)), list(range(40)), [], None, [7], [7]]
    queries = [(i, seq(14)) for i in range(200)] + [(900, list(range(4096))), (901, list(range(60))), (902, list(range(39))), (903, None), (904, []), (None, [7, 7]), (None, [7, 7])]
    q = spark.createDataFrame(queries, "query_id long, tokens array<int>").repartition(4)
    got = sorted(((r.query_id, r.matched, r.hit) for r in search.longest_prefix_join(q, spark.createDataFrame([(t,) for t in stored], "tokens array<int>")).collect()), key=str)
    best = lambda t: max((len(s) for s in stored if s and t and t[: len(s)] == s), default=0)
    assert got == sorted(((i, best(t), best(t) > 0) for i, t in queries), key=str)
    none = search.longest_prefix_join(q, spark.createDataFrame([(None,), ([],)], "tokens array<int>")).collect()
    assert len(none) == len(queries) and not any(r.hit for r in none)


def test_the_lengths_that_a_search_looks_at(spark):
    paths = {r.n: r.p for r in spark.range(1, 4097).select(F.col("id").cast("int").alias("n"), search._path(F.col("id").cast("int"), 4096, 13).alias("p")).collect()}
    assert all(p == sorted(p) and p[-1] == n and len(p) <= 13 for n, p in paths.items())


def test_repeated_messages_count_once_and_late_ones_go(spark):
    rows = [("p1", 0, "#### 1", "1", 100.0), ("p1", 1, "#### 2", "1", 101.0), ("p2", 0, "#### 1", "1", 102.0), ("p1", 2, None, "1", 103.0)]
    made = spark.createDataFrame(rows, "problem_id string, sample_idx long, reasoning string, expected string, at double")
    wrapped = envelopes.wrap(made, F.lit("raw_reasoning"), F.struct("problem_id", "sample_idx", "reasoning", "expected"), "problem_id", F.col("at"))
    path, out, offsets = new_path(spark, "topic"), new_path(spark, "out"), new_path(spark, "offsets")
    wrapped.unionByName(wrapped).write.parquet(path)
    stream = spark.readStream.schema(wrapped.schema).parquet(path)
    pipelines.run_available(pipelines.verify_once(stream), out, offsets)
    read = lambda: sorted((r.problem_id, r.path_hash[:2], r.is_correct) for r in spark.read.parquet(out).collect())
    once = read()
    assert len(once) == 3 and [x[2] for x in once].count(True) == 2
    # again later, from the same offsets: known paths are not graded again, and one from before the watermark is dropped
    later = made.limit(0).unionByName(spark.createDataFrame([("p3", 0, "#### 1", "1", 90_000.0), ("p1", 0, "#### 1", "1", 104.0)], made.schema))
    for batch in (later, spark.createDataFrame([("p4", 0, "#### 1", "1", 50.0)], made.schema)):
        envelopes.wrap(batch, F.lit("raw_reasoning"), F.struct("problem_id", "sample_idx", "reasoning", "expected"), "problem_id", F.col("at")).write.mode("append").parquet(path)
        pipelines.run_available(pipelines.verify_once(stream), out, offsets)
    assert [x[0] for x in read()] == ["p1", "p1", "p2", "p3"]


def test_messages_that_are_no_json_are_told_apart(spark):
    texts = ['{"type":"x","data":{"x":"1"},"timestamp":1.5}', '{"x":"2"}', "{broken", None, '{"type":"x","data":5}', '{"type":"x","timestamp":"soon"}', "17"]
    df = spark.createDataFrame([(t,) for t in texts], "value string")
    got = [(r.type, r.data.x if r.data else None, r.sent_at is not None, r.bad) for r in envelopes.unwrap(df, "x string").collect()]
    assert got == [("x", "1", True, False), (None, "2", False, False), (None, None, False, True), (None, None, False, True), ("x", None, False, False), ("x", None, False, False), (None, None, False, True)]


def test_a_bundle_is_read_whole_or_not_at_all(spark):
    path = new_path(spark, "bundle")
    schema = "problem_id string, reasoning string, is_correct boolean"
    pair = "prompt string, chosen string, rejected string"

    def publish_rows(n, stats):
        rows = spark.createDataFrame([(str(i), f"text {i}", i % 2 == 0) for i in range(n)], schema)
        raw = spark.createDataFrame([("p", "c", "r")] * n, pair)
        return sinks.publish_result_bundle(rows, rows, raw, spark.createDataFrame([], pair), stats, path)

    counted = lambda: {p: spark.read.json(f"{sinks.result_bundle(spark, path)}/{p}").count() for p in ("all", "by_verdict", "filtered", "full_pairs", "dpo_pairs", "stats")}
    # the last output fails, after all others were written
    broken = spark.range(1).select(F.raise_error(F.lit("gone")).alias("n"))
    with pytest.raises(Exception, match="gone"):
        publish_rows(2, broken)
    with pytest.raises(FileNotFoundError):
        sinks.result_bundle(spark, path)
    publish_rows(3, spark.range(1))
    assert counted() == {"all": 3, "by_verdict": 3, "filtered": 3, "full_pairs": 3, "dpo_pairs": 3, "stats": 1}
    with pytest.raises(Exception, match="gone"):
        publish_rows(5, broken)
    assert counted()["all"] == 3
    publish_rows(4, spark.range(1))
    assert counted() == {"all": 4, "by_verdict": 4, "filtered": 4, "full_pairs": 4, "dpo_pairs": 4, "stats": 1}
