"""Counters and summaries over rollouts, runs and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollforge.functions import text as tx


def generation_stats(samples: DataFrame) -> DataFrame:
    return samples.agg(F.countDistinct("problem_id").alias("problems"), F.count("*").alias("paths"), F.count_if("is_correct").alias("correct"), F.count_if(~F.col("is_correct")).alias("incorrect"))


def model_metrics(responses: DataFrame) -> DataFrame:
    """By model: responses, mean length and steps, share correct."""
    return responses.groupBy("model").agg(F.count("*").alias("n"), F.round(F.avg(F.length("reasoning")), 4).alias("avg_length"), F.round(F.avg(tx.eval_step_count("reasoning")), 4).alias("avg_steps"), F.round(F.avg(F.col("is_correct").cast("int")), 6).alias("correct_at_1"))


def method_metrics(rows: DataFrame, baseline: str) -> DataFrame:
    """By method: share of full rewards, mean reward, margin over the baseline column, mean length."""
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return rows.groupBy("method").agg(mean((F.col("reward") == 1).cast("double"), "accuracy"), mean("reward", "reward"), mean(F.col("reward") - F.col(baseline), "margin"), mean(F.length("reasoning"), "avg_length"))


def scaling_efficiency(runs: DataFrame) -> DataFrame:
    """workers, throughput, speedup over the fewest workers and efficiency in percent. One row per worker count."""
    base = F.first_value("throughput").over(Window.orderBy("workers"))
    return runs.withColumn("base", base).select("workers", "throughput", F.round(F.col("throughput") / F.col("base"), 4).alias("speedup"), F.round(F.col("throughput") / F.col("base") / F.col("workers") * 100, 3).alias("efficiency"))


def cache_hit_stats(log: DataFrame) -> DataFrame:
    """By shard, and under null for all shards: hits, misses, rate."""
    return log.rollup("shard").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.round(F.try_divide(F.count_if("hit"), F.count("*")), 6).alias("hit_rate"))


def acceptance_stats(log: DataFrame, drafted_per_step: int) -> DataFrame:
    rate = F.coalesce(F.try_divide(F.sum("accepted"), F.sum("drafted")), F.lit(0.0))
    return log.groupBy("run").agg(F.sum("accepted").alias("accepted"), F.sum("drafted").alias("drafted"), F.round(rate, 6).alias("acceptance_rate"), F.round(rate * drafted_per_step + 1, 6).alias("speedup"))


def tokens_per_second(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.try_divide(F.sum("tokens"), F.sum("seconds")), 4).alias("tokens_per_second"))


def detail_truncate(details: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Long fields cut to their first characters."""
    return details.withColumns({c: F.substring(c, 1, n) for c, n in limits.items()})


def annotate_errors(rows: DataFrame, source: str) -> DataFrame:
    """Adds value and error: a failing row stays, with the reason."""
    value = F.col(source).try_cast("double")
    return rows.withColumns({"value": value, "error": F.when(value.isNull(), "not a number")})
