"""Tables of texts are small, and gone when no step reads them any more."""

import os

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollforge import jobs
from rollforge.operators import pairs
from rollforge.sources import sinks
from rollforge.sources.scratch import new_path, shared_dir


@pytest.fixture
def samples(spark):
    say = lambda i: "Step 1: read the question. Step 2: think. " + " ".join(f"word{i}x{j}" for j in range(60)) + f"\n#### {i}"
    rows = [("p", i, "q", say(i), i % 2 == 0, i / 40) for i in range(40)]
    return spark.createDataFrame(rows, "problem_id string, sample_idx int, problem string, reasoning string, is_correct boolean, verification_confidence double")


@pytest.mark.parametrize("scored", [10, 10_000])
def test_only_texts_and_words_of_pairs_move(samples, monkeypatch, scored):
    made, plain = {}, pairs.written
    monkeypatch.setattr(pairs, "SCORED_PAIRS", scored)

    def seen(df, name):
        made[name] = plain(df, name)
        return made[name]

    monkeypatch.setattr(pairs, "written", seen)
    got = pairs.smart_pair_join(samples, 0.2, 2).collect()
    assert sorted((r.rank, r.chosen != r.rejected, r.prompt) for r in got) == [(1, True, "q"), (2, True, "q")]
    assert made["texts"].count() <= 4 < made["sides"].count()


def test_a_run_leaves_its_output_alone(spark, samples):
    held = shared_dir(spark).removeprefix("file://")
    path = new_path(spark, "run")
    sinks.write_samples_jsonl(samples, f"{path}/in")
    before = set(os.listdir(held))
    counts = {r.name: r.n for r in jobs.preprocess_jsonl(spark, f"{path}/in", f"{path}/samples", f"{path}/pairs").collect()}
    assert (counts["input_samples"], counts["output_samples"], counts["pairs_created"]) == (40, 40, 5)
    left = {name.split("-")[0] for name in set(os.listdir(held)) - before}
    assert not left & {"samples", "keyed", "sets", "sides", "texts"}
    assert spark.read.json(f"{path}/samples").count() == 40 and spark.read.json(f"{path}/in").count() == 40


def test_a_bundle_keeps_no_second_copy(spark, samples, monkeypatch):
    monkeypatch.setattr(DataFrame, "persist", lambda *_: pytest.fail("samples are kept"))
    path = new_path(spark, "bundle")
    more = samples.unionByName(samples.limit(1).withColumns({"sample_idx": F.lit(40), "is_correct": F.lit(None).cast("boolean"), "reasoning": F.lit("a\u0000\n\u2028 \"b\"")}))
    sinks.write_result_bundle(more, samples, samples, pairs.smart_pair_join(samples), samples.agg(F.count("*").alias("n")), path)
    split = spark.read.schema(more.schema).json([f"{path}/by_verdict/verdict=correct", f"{path}/by_verdict/verdict=incorrect"])
    assert sorted(map(str, split.collect())) == sorted(map(str, more.collect()))
    assert spark.read.json(f"{path}/by_verdict").where("verdict = 'incorrect'").count() == 21
    files = [name for part in ("all", "filtered", "dpo_pairs") for name in os.listdir(f"{path}/{part}".removeprefix("file://")) if name.startswith("part-")]
    assert files and all(name.endswith(".json.gz") for name in files)
