"""Problems with few pairs: each row moves once, and the pairs are those of the longer way."""

from rollforge.operators import pairs
from rollforge.plans.grading import graded


def test_rows_of_small_problems_move_once(spark):
    rows = [(f"p{i // 4}", i % 4, i % 4 < 2, 0.5, "q", f"word{i} and {i % 3} more") for i in range(40)]
    samples = spark.createDataFrame(rows, "problem_id string, sample_idx long, is_correct boolean, confidence double, prompt string, reasoning string")
    for made in (pairs.pair_join(samples), pairs.smart_pair_join(samples)):
        assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
        assert made.count() == 40


def test_pairs_are_the_same_whatever_counts_as_few(spark, sf_dir, monkeypatch):
    made = []
    for few in (pairs.FEW_PAIRS, 4, 0):
        monkeypatch.setattr(pairs, "FEW_PAIRS", few)
        made.append([sorted(map(tuple, op(graded(spark, sf_dir)).collect())) for op in (pairs.pair_join, pairs.smart_pair_join)])
    assert made[0] == made[1] == made[2] and made[0][0] and made[0][1]
