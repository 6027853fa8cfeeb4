"""Evaluation: verdict tables, pass@k, votes, budgets, summaries and run comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollforge.functions.text import strip
from rollforge.operators.ordinals import numbered


def judge_tests(runs: DataFrame) -> DataFrame:
    """Per task: success when every test's trimmed output is as expected. Hidden tests keep no output in the details."""
    ok = strip("stdout") == strip("expected_output")
    detail = F.struct("test_id", ok.alias("passed"), F.when(F.col("is_hidden"), "hidden").otherwise(strip("stdout")).alias("output"))
    return runs.groupBy("task_id").agg(
        F.when(F.bool_and(ok), "success").otherwise("wrong_answer").alias("status"), F.count("*").alias("tests"), F.count_if(ok).alias("passed"), F.count_if("is_hidden").alias("hidden"), F.array_sort(F.collect_list(detail)).alias("details")
    )


def pass_at_k(problems: DataFrame, samples: DataFrame, ks: list[int]) -> DataFrame:
    """k, n_problems, passed, pass_rate: any correct among the first k samples. Problems without samples count as failed.

    One aggregation finds each problem's first correct sample; every k then reads that number. No filter on the verdict
    comes before it: pushed below the grading, it would compute the verdict twice.
    """
    first = samples.groupBy("problem_id").agg(F.min(F.when(F.col("is_correct"), F.col("sample_idx"))).alias("first_correct"))
    per = problems.select("problem_id").join(first, "problem_id", "left")
    hits = per.agg(F.count("*").alias("n_problems"), *[F.count_if(F.col("first_correct") < k).alias(f"k{k}") for k in ks])
    rows = hits.select("n_problems", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("passed")) for k in ks])).alias("r"))
    return rows.select("r.k", "n_problems", "r.passed", F.round(F.try_divide(F.col("r.passed"), F.col("n_problems")), 6).alias("pass_rate"))


def k_cross_join(results: DataFrame, ks: list[int]) -> DataFrame:
    """Every result row with every k."""
    return results.select("*", F.explode(F.array(*map(F.lit, ks))).alias("k"))


def vote_counts(samples: DataFrame) -> DataFrame:
    """problem_id, answer, votes, first_idx, weight and best_idx (its best path) of each distinct answer; empty answers are none."""
    best = F.max_by("sample_idx", F.struct("score", -F.col("sample_idx")))
    answer = F.nullif("answer", F.lit("")) if samples.schema["answer"].dataType.typeName() == "string" else F.col("answer")
    return samples.groupBy("problem_id", answer.alias("answer")).agg(F.count("*").alias("votes"), F.min("sample_idx").alias("first_idx"), F.sum("score").alias("weight"), best.alias("best_idx"), F.max("score").alias("top"))


def _voted(samples: DataFrame, by: Column, path: str) -> DataFrame:
    """The answer that is first by a struct, with its path; a problem without any answer keeps its best path."""
    some = F.col("answer").isNotNull()
    only = lambda c: F.when(some, c)
    picked = lambda c: F.max_by(only(F.col(c)), only(by))
    return vote_counts(samples).groupBy("problem_id").agg(
        picked("answer").alias("answer"), F.coalesce(F.max(only(F.col("votes"))), F.lit(0)).alias("votes"), F.coalesce(F.sum(only(F.col("votes"))), F.lit(0)).alias("n_answers"),
        F.max(only(F.round("weight", 9))).alias("weight"), F.coalesce(picked(path), F.max_by("best_idx", F.struct("top", -F.col("best_idx")))).alias("best_idx"),
    )


def majority_vote(samples: DataFrame) -> DataFrame:
    """problem_id, answer, votes, n_answers, confidence, best_idx: the most frequent answer, the first seen of equals, and its first path.

    Without any answer the answer and the confidence are null and best_idx is the path with the best score.
    """
    voted = _voted(samples, F.struct("votes", -F.col("first_idx")), "first_idx")
    return voted.select("problem_id", "answer", "votes", "n_answers", F.round(F.try_divide("votes", "n_answers"), 6).alias("confidence"), "best_idx")


def weighted_vote(samples: DataFrame) -> DataFrame:
    """problem_id, answer, weight, best_idx: the answer with the largest sum of scores, and its best path.

    Without any answer the answer and the weight are null and best_idx is the path with the best score.
    """
    return _voted(samples, F.struct(F.round("weight", 9), -F.col("first_idx")), "best_idx").select("problem_id", "answer", "weight", "best_idx")


def best_of_n(samples: DataFrame) -> DataFrame:
    """problem_id, best_idx, score: the highest score, the first of equals."""
    best = F.struct("score", -F.col("sample_idx"))
    return samples.groupBy("problem_id").agg(F.max_by("sample_idx", best).alias("best_idx"), F.max("score").alias("score"))


def score_paths(reward: Column, is_correct: Column) -> Column:
    """The reward model's score, and 10 for a verified answer."""
    return F.coalesce(reward, F.lit(0.0)) + F.when(is_correct, 10.0).otherwise(0.0)


def verifier_guided_budget(problems: DataFrame, samples: DataFrame, batch: int = 8, most: int = 64) -> DataFrame:
    """problem_id, solved, used: samples drawn in batches until one is correct or the budget is gone."""
    first = samples.groupBy("problem_id").agg(F.min(F.when(F.col("is_correct") & (F.col("sample_idx") < most), F.col("sample_idx"))).alias("at"))
    used = F.coalesce(F.lit(batch) * F.ceil((F.col("at") + 1) / batch), F.lit(most)).cast("long")
    return problems.select("problem_id").join(first, "problem_id", "left").select("problem_id", F.col("at").isNotNull().alias("solved"), used.alias("used"))


def first_verified(samples: DataFrame, attempts: int) -> DataFrame:
    """problem_id, sample_idx of the first verified sample within the attempts, else null."""
    ok = F.col("is_correct") & (F.col("sample_idx") < attempts)
    return samples.groupBy("problem_id").agg(F.min(F.when(ok, F.col("sample_idx"))).alias("sample_idx"))


def benchmark_summary(problems: DataFrame, verdicts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """total, correct, incorrect, errors, accuracy, mean time; a problem without a verdict is an error."""
    rows = problems.join(verdicts, "problem_id", "left")
    error = F.col("is_correct").isNull() | F.coalesce(F.col("failed"), F.lit(False))
    right = F.coalesce(F.col("is_correct"), F.lit(False)) & ~error
    return rows.groupBy(*(by or [])).agg(
        F.count("*").alias("total"), F.count_if(right).alias("correct"), (F.count("*") - F.count_if(right) - F.count_if(error)).alias("incorrect"), F.count_if(error).alias("errors"),
        F.round(F.try_divide(F.count_if(right), F.count("*")), 6).alias("accuracy"), F.round(F.try_divide(F.coalesce(F.sum("seconds"), F.lit(0.0)), F.count("*")), 6).alias("mean_seconds"),
    )


def compare_runs(metrics: DataFrame, base: str, candidate: str) -> DataFrame:
    """metric, base, candidate, delta in points. metrics: run, metric, value."""
    side = lambda run, name: F.max(F.when(F.col("run") == run, F.col("value"))).alias(name)
    both = metrics.groupBy("metric").agg(side(base, "base"), side(candidate, "candidate"))
    return both.select("metric", "base", "candidate", F.round((F.col("candidate") - F.col("base")) * 100, 4).alias("delta"))


def best_method(metrics: DataFrame) -> DataFrame:
    """The best method by each measure; equals go to the first name. metrics: method, accuracy, reward, margin."""
    pick = lambda c: F.min_by("method", F.struct(-F.col(c), "method")).alias(f"best_{c}")
    return metrics.agg(pick("accuracy"), pick("reward"), pick("margin"))


def latency_summary(log: DataFrame, by: list[str], seconds: str = "seconds", min_p95: int = 21, min_p99: int = 101, exact: bool = True) -> DataFrame:
    """Rows, throughput, mean, median, p95 and p99 in milliseconds; high percentiles are 0 below a least number of rows.

    Exact nearest ranks come from row numbers that no single task has to make; exact=False takes approximate ones in
    one aggregation.
    """
    if exact:
        ranked = numbered(log.select(*by, seconds), by, [seconds])
        at = lambda p: F.max(F.when(F.col("place") == F.floor(F.col("place_n") * p), F.col(seconds)))
        middle = F.avg(F.when(F.col("place").between(F.floor((F.col("place_n") - 1) / 2), F.floor(F.col("place_n") / 2)), F.col(seconds)))
    else:
        ranked = log
        at = lambda p: F.percentile_approx(seconds, p, 10_000)
        middle = F.percentile_approx(seconds, 0.5, 10_000)
    n, ms = F.count("*"), lambda c: F.round(c * 1000, 4)
    return ranked.groupBy(*by).agg(
        n.alias("n"), F.round(F.try_divide(n, F.sum(seconds)), 4).alias("throughput"), ms(F.avg(seconds)).alias("avg_ms"), ms(middle).alias("p50_ms"),
        F.when(n >= min_p95, ms(at(0.95))).otherwise(0.0).alias("p95_ms"), F.when(n >= min_p99, ms(at(0.99))).otherwise(0.0).alias("p99_ms"),
    )


#: A sketch of this size is off by less than 2 % of the ranks.
SKETCH = 400


def latency_sketches(log: DataFrame, by: list[str], seconds: str = "seconds") -> DataFrame:
    """by, n, total, sketch (KLL): mergeable sums, as they are stored by day and worker, of bounded size each."""
    return log.groupBy(*by).agg(F.count(seconds).alias("n"), F.sum(seconds).alias("total"), F.kll_sketch_agg_double(seconds, SKETCH).alias("sketch"))


def latency_of_sketches(sketches: DataFrame, by: list[str], min_p95: int = 21, min_p99: int = 101) -> DataFrame:
    """latency_summary of stored sketches: percentiles are off by less than 2 % of the ranks, all else is exact."""
    merged = sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.kll_merge_agg_double("sketch", SKETCH).alias("sketch"))
    at = lambda p: F.round(F.kll_sketch_get_quantile_double("sketch", F.lit(p)) * 1000, 4)
    n = F.col("n")
    return merged.select(
        *by, "n", F.round(F.try_divide(n, F.col("total")), 4).alias("throughput"), F.round(F.try_divide(F.col("total"), n) * 1000, 4).alias("avg_ms"), at(0.5).alias("p50_ms"),
        F.when(n >= min_p95, at(0.95)).otherwise(0.0).alias("p95_ms"), F.when(n >= min_p99, at(0.99)).otherwise(0.0).alias("p99_ms"),
    )
