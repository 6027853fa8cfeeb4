"""Small inputs of large work are dealt out, and the sets of small problems meet without their prefixes."""

from pyspark.sql import functions as F

from rollforge import jobs
from rollforge.operators import clean
from rollforge.plans.sources import echo


def test_generation_is_dealt_out_over_the_cores(spark, tmp_path):
    problems = spark.createDataFrame([(f"p{i}", f"question {i}", "0") for i in range(200)], jobs.PROBLEMS).coalesce(1)
    jobs.generate(spark, problems, echo, 2, f"file://{tmp_path}")
    rows = spark.read.parquet(f"{tmp_path}/generated")
    assert rows.count() == 400 and rows.select(F.input_file_name()).distinct().count() >= 2
    last = rows.groupBy("problem_id").agg(F.array_sort(F.collect_list(F.substring("reasoning", -1, 1))).alias("last")).select("last").distinct()
    assert [r.last for r in last.collect()] == [["0", "1"]]


def test_sets_of_small_problems_meet_without_prefixes(spark, monkeypatch):
    asked = []
    real = clean._near_by_prefix
    monkeypatch.setattr(clean, "_near_by_prefix", lambda *a: asked.append(1) or real(*a))
    texts = [" ".join(f"w{i + j // 25}x{j % 40}" for j in range(30)) for i in range(6)]
    rows = [(f"p{p}", i, t + f" end{i % 2}") for p in range(3) for i, t in enumerate([*texts, texts[0]])]
    samples = spark.createDataFrame(rows, "problem_id string, sample_idx long, reasoning string")
    found = lambda: sorted(tuple(r) for r in clean.near_duplicates(samples, 0.5).collect())
    direct = found()
    assert not asked and direct
    monkeypatch.setattr(clean, "FEW_SETS", 1)
    assert found() == direct and asked
