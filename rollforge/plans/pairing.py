"""Pair queries over graded rollouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollforge.functions import grade
from rollforge.operators import pairs
from rollforge.plans.derived import ROLLOUTS, read, rollouts
from rollforge.plans.grading import GRADED, SQL_REWARDS, _CAND, graded, sql_truth
from rollforge.plans.registry import query

_SIDES = f"""{GRADED}, s AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(reasoning), '\\s+'), lambda x: x <> '')) AS t FROM graded),
  j AS (SELECT c.problem_id, c.sample_idx AS c_idx, r.sample_idx AS r_idx, c.problem AS prompt, c.reasoning AS chosen, r.reasoning AS rejected, c.confidence AS cc, r.confidence AS rc, 1 - len(list_intersect(c.t, r.t)) / (len(c.t) + len(r.t) - len(list_intersect(c.t, r.t))) AS d
        FROM s c JOIN s r ON c.problem_id = r.problem_id AND c.is_correct AND NOT r.is_correct)"""


@query(f"WITH {_SIDES} SELECT problem_id, c_idx, r_idx, prompt, chosen, rejected, round(d, 6) AS diversity_score FROM j WHERE d >= 0.1")
def pair_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.pair_join(graded(spark, sf_dir)).withColumn("diversity_score", F.round("diversity_score", 6))


_SMART = f"{_SIDES}, smart AS (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY d DESC, cc DESC, c_idx, rc DESC, r_idx) AS rank FROM j WHERE d >= 0.2)"


@query(f"WITH {_SMART} SELECT problem_id, rank, c_idx, r_idx, prompt, chosen, rejected, round(d, 6) AS diversity_score, cc AS chosen_confidence, rc AS rejected_confidence FROM smart WHERE rank <= 5")
def smart_pair_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.smart_pair_join(graded(spark, sf_dir)).withColumn("diversity_score", F.round("diversity_score", 6))


@query(f"WITH {_SMART} SELECT problem_id, c_idx, r_idx, rank FROM smart WHERE rank <= 2")
def top_n_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.smart_pair_join(graded(spark, sf_dir), most=2).select("problem_id", "c_idx", "r_idx", "rank")


@query(f"WITH {GRADED} SELECT c.problem_id, c.sample_idx AS c_idx, r.sample_idx AS r_idx FROM graded c JOIN graded r ON c.problem_id = r.problem_id WHERE c.is_correct AND NOT r.is_correct")
def rejection_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.rejection_pairs(graded(spark, sf_dir))


_FEW = f"{GRADED}, few AS (SELECT *, row_number() OVER (PARTITION BY problem_id, is_correct ORDER BY sample_idx) AS rank FROM graded), capped AS (SELECT c.problem_id, c.sample_idx AS c_idx, r.sample_idx AS r_idx FROM few c JOIN few r ON c.problem_id = r.problem_id WHERE c.is_correct AND NOT r.is_correct AND c.rank <= 2 AND r.rank <= 2)"


@query(f"WITH {_FEW} SELECT problem_id, c_idx, r_idx FROM capped")
def capped_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.capped_pairs(graded(spark, sf_dir))


@query(f"WITH {GRADED} SELECT problem_id, sample_idx, is_correct, row_number() OVER (PARTITION BY problem_id, is_correct ORDER BY confidence DESC, sample_idx) AS rank FROM graded")
def confidence_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.confidence_rank(graded(spark, sf_dir)).select("problem_id", "sample_idx", "is_correct", "rank")


@query(f"WITH {GRADED} SELECT problem_id, sample_idx, is_correct FROM graded WHERE problem_id IN (SELECT problem_id FROM graded GROUP BY 1 HAVING bool_or(is_correct) AND bool_or(NOT is_correct))")
def both_sides_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.both_sides(graded(spark, sf_dir).select("problem_id", "sample_idx", "is_correct"))


@query(f"""WITH {ROLLOUTS}, s AS (SELECT *, coalesce(nullif(regexp_extract_all(reasoning, '{_CAND}', 1)[-1], ''), regexp_extract_all(reasoning, '{_CAND}', 2)[-1]) AS said FROM rollouts),
    w AS (SELECT problem_id, arg_min(reasoning, sample_idx) AS wrong_text FROM s WHERE coalesce(abs(try_cast(said AS DOUBLE) - try_cast({sql_truth('expected')} AS DOUBLE)) > 0.01, false) GROUP BY 1),
    p AS (SELECT 'p' || o_orderkey AS problem_id, 'It is #### ' || floor(o_totalprice)::BIGINT AS solution, floor(o_totalprice)::BIGINT AS answer FROM orders)
    SELECT problem_id, solution AS chosen, coalesce(wrong_text, 'Let me work through this step by step...' || chr(10) || chr(10) || 'After careful calculation, the answer is ' || (answer + 7) || '.') AS rejected FROM p LEFT JOIN w USING (problem_id)""")
def preference_from_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.floor("o_totalprice").cast("long").cast("string")
    problems = read(spark, sf_dir, "orders").select(F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("problem_id"), F.concat(F.lit("It is #### "), total).alias("solution"), total.alias("answer"))
    return pairs.preference_from_benchmark(problems, rollouts(spark, sf_dir), grade.is_rejected_candidate("reasoning", "expected"))


@query(f"WITH {_FEW}, {SQL_REWARDS} SELECT c.problem_id, c_idx, r_idx, a.reward AS chosen_reward, b.reward AS rejected_reward FROM capped c LEFT JOIN rewards a ON a.problem_id = c.problem_id AND a.sample_idx = c_idx LEFT JOIN rewards b ON b.problem_id = c.problem_id AND b.sample_idx = r_idx")
def rejudge_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rewards = rollouts(spark, sf_dir).select("problem_id", "sample_idx", grade.partial_credit_reward("reasoning", "expected").alias("reward"))
    return pairs.rejudge_rewards(pairs.capped_pairs(graded(spark, sf_dir)), rewards)


@query(f"WITH {_SMART} SELECT prompt, chosen, rejected FROM smart WHERE rank <= 5")
def to_dpo_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.to_dpo_format(pairs.smart_pair_join(graded(spark, sf_dir)))
