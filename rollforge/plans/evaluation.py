"""Evaluation queries: pass@k, votes, budgets, summaries, comparisons, latency."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollforge import jobs
from rollforge.functions import grade
from rollforge.functions import text as tx
from rollforge.operators import evals, metrics, search
from rollforge.plans.derived import ANSWERS, CHATS, STEPS, answers, chats, read, rollouts, steps
from rollforge.plans.grading import _MARKED, GRADED, SQL_REWARDS, graded
from rollforge.plans.registry import query
from rollforge.sources.scratch import new_path, written

KS = [1, 4, 8]
_PROBLEMS = "problems AS (SELECT 'p' || o_orderkey AS problem_id, o_orderpriority AS level, o_orderstatus AS type FROM orders)"
_FIRST = f"WITH {GRADED}, {_PROBLEMS}, f AS (SELECT problem_id, min(sample_idx) FILTER (WHERE is_correct) AS first_correct FROM graded GROUP BY 1), p AS (SELECT problem_id, first_correct FROM problems LEFT JOIN f USING (problem_id))"


def problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as problems; some have no rollouts."""
    return read(spark, sf_dir, "orders").select(F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("problem_id"), F.col("o_orderpriority").alias("level"), F.col("o_orderstatus").alias("type"))


def voters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """problem_id, sample_idx, answer, score."""
    rows = rollouts(spark, sf_dir)
    return rows.select("problem_id", "sample_idx", "expected", grade.extract_marked_number("reasoning").alias("answer"), F.round(F.col("confidence") * 10 + F.col("quantity") / 100, 4).alias("score"))


_VOTERS = f"voters AS (SELECT problem_id, sample_idx, expected, {_MARKED} AS answer, round(confidence * 10 + quantity / 100, 4) AS score FROM rollouts)"
_COUNTS = f"""WITH {GRADED}, {_VOTERS}, v AS (SELECT problem_id, answer, count(*) AS votes, min(sample_idx) AS first_idx, round(sum(score), 9) AS weight FROM voters WHERE answer <> '' GROUP BY 1, 2),
  best AS (SELECT problem_id, arg_max(sample_idx, row(score, -sample_idx)) AS best_idx FROM voters GROUP BY 1)"""


@query(f"{_FIRST} SELECT k, count(*) AS n_problems, count_if(first_correct < k) AS passed, round(count_if(first_correct < k) / count(*), 6) AS pass_rate FROM p, (VALUES (1), (4), (8)) t(k) GROUP BY k")
def pass_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.pass_at_k(problems(spark, sf_dir), graded(spark, sf_dir).select("problem_id", "sample_idx", "is_correct"), KS)


@query(f"WITH {GRADED} SELECT problem_id, count_if(is_correct) AS correct, k FROM graded, (VALUES (1), (4), (8)) t(k) GROUP BY problem_id, k")
def k_cross_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.k_cross_join(graded(spark, sf_dir).groupBy("problem_id").agg(F.count_if("is_correct").alias("correct")), KS)


@query(f"WITH {GRADED}, {_PROBLEMS} SELECT p.problem_id, p.level, sample_idx, is_correct FROM problems p LEFT JOIN graded USING (problem_id)")
def join_paths_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return problems(spark, sf_dir).join(graded(spark, sf_dir).select("problem_id", "sample_idx", "is_correct"), "problem_id", "left").select("problem_id", "level", "sample_idx", "is_correct")


_MAJORITY = f"{_COUNTS}, m AS (SELECT problem_id, arg_max(answer, row(votes, -first_idx)) AS answer, arg_max(first_idx, row(votes, -first_idx)) AS idx, max(votes) AS votes, sum(votes)::BIGINT AS n_answers, max(votes) / sum(votes) AS confidence FROM v GROUP BY 1)"


@query(f"{_MAJORITY} SELECT b.problem_id, answer, coalesce(votes, 0) AS votes, coalesce(n_answers, 0) AS n_answers, round(confidence, 6) AS confidence, coalesce(idx, best_idx) AS best_idx FROM best b LEFT JOIN m USING (problem_id)")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.majority_vote(voters(spark, sf_dir))


@query(f"{_MAJORITY}, t AS (SELECT DISTINCT problem_id, expected FROM voters) SELECT count(*) AS n_problems, count_if(answer = expected) AS correct, round(avg(confidence), 6) AS mean_confidence FROM t LEFT JOIN m USING (problem_id)")
def self_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = voters(spark, sf_dir)
    truth = rows.select("problem_id", "expected").distinct()
    voted = evals.majority_vote(rows.drop("expected"))
    return truth.join(voted, "problem_id", "left").agg(F.count("*").alias("n_problems"), F.count_if(F.col("answer") == F.col("expected")).alias("correct"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


@query(f"{_COUNTS}, w AS (SELECT problem_id, arg_max(answer, row(weight, -first_idx)) AS answer, max(weight) AS weight FROM v GROUP BY 1), p AS (SELECT w.problem_id, w.answer, w.weight, arg_max(x.sample_idx, row(x.score, -x.sample_idx)) AS idx FROM w JOIN voters x ON w.problem_id = x.problem_id AND w.answer = x.answer GROUP BY ALL) SELECT b.problem_id, answer, round(weight, 6) AS weight, coalesce(idx, best_idx) AS best_idx FROM best b LEFT JOIN p USING (problem_id)")
def weighted_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.weighted_vote(voters(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


@query(f"WITH {GRADED}, {_VOTERS} SELECT problem_id, arg_max(sample_idx, row(score, -sample_idx)) AS best_idx, max(score) AS score FROM voters GROUP BY 1")
def best_of_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.best_of_n(voters(spark, sf_dir))


@query(f"WITH {GRADED} SELECT problem_id, sample_idx, round(confidence + CASE WHEN is_correct THEN 10 ELSE 0 END, 6) AS score FROM graded")
def score_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graded(spark, sf_dir).select("problem_id", "sample_idx", F.round(evals.score_paths(F.col("confidence"), F.col("is_correct")), 6).alias("score"))


@query(f"WITH {GRADED}, {_PROBLEMS}, f AS (SELECT problem_id, min(sample_idx) FILTER (WHERE is_correct AND sample_idx < 64) AS first_at FROM graded GROUP BY 1) SELECT problem_id, first_at IS NOT NULL AS solved, coalesce(8 * ceil((first_at + 1) / 8), 64)::BIGINT AS used FROM problems LEFT JOIN f USING (problem_id)")
def verifier_guided_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.verifier_guided_budget(problems(spark, sf_dir), graded(spark, sf_dir).select("problem_id", "sample_idx", "is_correct"))


@query(f"WITH {GRADED} SELECT problem_id, min(sample_idx) FILTER (WHERE is_correct AND sample_idx < 3) AS sample_idx FROM graded GROUP BY 1")
def first_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.first_verified(graded(spark, sf_dir), 3)


_VERDICTS = f"{GRADED}, {_PROBLEMS}, v AS (SELECT problem_id, arg_min(is_correct, sample_idx) AS is_correct, arg_min(status = 'parse_error', sample_idx) AS failed, sum(confidence) AS seconds FROM graded GROUP BY 1), b AS (SELECT *, is_correct IS NULL OR coalesce(failed, false) AS error FROM problems LEFT JOIN v USING (problem_id))"
_SUMS = "count(*) AS total, count_if(is_correct AND NOT error) AS correct, count(*) - count_if(is_correct AND NOT error) - count_if(error) AS incorrect, count_if(error) AS errors, round(count_if(is_correct AND NOT error) / count(*), 6) AS accuracy, round(coalesce(sum(seconds), 0) / count(*), 6) AS mean_seconds"


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = graded(spark, sf_dir).groupBy("problem_id")
    return first.agg(F.min_by("is_correct", "sample_idx").alias("is_correct"), F.min_by(F.col("status") == "parse_error", "sample_idx").alias("failed"), F.sum("confidence").alias("seconds"))


@query(f"WITH {_VERDICTS} SELECT {_SUMS} FROM b")
def benchmark_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.benchmark_summary(problems(spark, sf_dir), _verdicts(spark, sf_dir))


@query(f"WITH {_VERDICTS} SELECT level, type, {_SUMS} FROM b GROUP BY level, type")
def summary_by_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.benchmark_summary(problems(spark, sf_dir), _verdicts(spark, sf_dir), ["level", "type"])


@query(f"WITH {GRADED} SELECT count(DISTINCT problem_id) AS problems, count(*) AS paths, count_if(is_correct) AS correct, count_if(NOT is_correct) AS incorrect FROM graded")
def generation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.generation_stats(graded(spark, sf_dir))


@query(f"WITH {ANSWERS} SELECT lang AS model, count(*) AS n, round(avg(length(reasoning)), 4) AS avg_length, round(avg(greatest(len(regexp_extract_all(reasoning, '(?im)step\\s*\\d+')) + len(regexp_extract_all(reasoning, '(?im)^\\d+\\.')) + len(regexp_extract_all(reasoning, '(?im)first|second|third|then|next|finally')), len(regexp_extract_all(reasoning, chr(10))) // 2)), 4) AS avg_steps, round(count_if(is_correct) / count(*), 6) AS correct_at_1 FROM answers GROUP BY 1")
def model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.model_metrics(answers(spark, sf_dir).withColumnRenamed("lang", "model"))


@query(f"WITH {ANSWERS} SELECT problem_id, sample_idx, greatest(len(regexp_extract_all(reasoning, '(?im)step\\s*\\d+')) + len(regexp_extract_all(reasoning, '(?im)^\\d+\\.')) + len(regexp_extract_all(reasoning, '(?im)first|second|third|then|next|finally')), len(regexp_extract_all(reasoning, chr(10))) // 2) AS steps FROM answers")
def count_reasoning_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(spark, sf_dir).select("problem_id", "sample_idx", tx.eval_step_count("reasoning").alias("steps"))


_METHODS = f"WITH {GRADED}, {SQL_REWARDS}, mm AS (SELECT 'style' || (sample_idx % 7) AS method, round(avg(CASE WHEN reward = 1 THEN 1.0 ELSE 0 END), 6) AS accuracy, round(avg(reward), 6) AS reward, round(avg(reward - confidence), 6) AS margin, round(avg(length(reasoning)), 6) AS avg_length FROM rewards GROUP BY 1)"


def _methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rollouts(spark, sf_dir).withColumn("reward", grade.partial_credit_reward("reasoning", "expected"))
    return metrics.method_metrics(rows.withColumn("method", F.concat(F.lit("style"), (F.col("sample_idx") % 7).cast("string"))), baseline="confidence")


@query(f"{_METHODS} SELECT * FROM mm")
def method_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _methods(spark, sf_dir)


@query(f"{_METHODS} SELECT arg_min(method, row(-accuracy, method)) AS best_accuracy, arg_min(method, row(-reward, method)) AS best_reward, arg_min(method, row(-margin, method)) AS best_margin FROM mm")
def best_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.best_method(_methods(spark, sf_dir))


@query(f"{_METHODS}, u AS (SELECT method, 'accuracy' AS metric, accuracy AS value FROM mm UNION ALL SELECT method, 'reward', reward FROM mm UNION ALL SELECT method, 'margin', margin FROM mm) SELECT metric, max(value) FILTER (WHERE method = 'style1') AS base, max(value) FILTER (WHERE method = 'style0') AS candidate, round((max(value) FILTER (WHERE method = 'style0') - max(value) FILTER (WHERE method = 'style1')) * 100, 4) AS delta FROM u GROUP BY 1")
def compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = _methods(spark, sf_dir).unpivot(["method"], ["accuracy", "reward", "margin"], "metric", "value").withColumnRenamed("method", "run")
    return evals.compare_runs(long, "style1", "style0")


@query(f"{_FIRST}, b AS (SELECT problem_id, arg_max(is_correct, row(confidence, -sample_idx)) AS is_correct FROM graded GROUP BY 1) SELECT 'pass@' || k AS method, count_if(first_correct < k) AS solved FROM p, (VALUES (1), (4), (8)) t(k) GROUP BY k UNION ALL SELECT 'best_of_n', count_if(is_correct) FROM b")
def union_method_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graded(spark, sf_dir).select("problem_id", "sample_idx", "is_correct", F.col("confidence").alias("score"))
    passed = evals.pass_at_k(problems(spark, sf_dir), rows, KS).select(F.concat(F.lit("pass@"), F.col("k").cast("string")).alias("method"), F.col("passed").alias("solved"))
    best = evals.best_of_n(rows).join(rows.select("problem_id", F.col("sample_idx").alias("best_idx"), "is_correct"), ["problem_id", "best_idx"])
    return passed.unionByName(best.agg(F.count_if("is_correct").alias("solved")).select(F.lit("best_of_n").alias("method"), "solved"))


@query(f"{_FIRST} SELECT * FROM (SELECT k, count_if(first_correct < k) AS passed FROM p, (VALUES (1), (4), (8)) t(k) GROUP BY k) ORDER BY k")
def sort_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pass_at_k(spark, sf_dir).select("k", "passed").orderBy("k")


_LAT = f"""WITH {STEPS}, o AS (SELECT worker, seconds, row_number() OVER (PARTITION BY worker ORDER BY seconds) - 1 AS i, count(*) OVER (PARTITION BY worker) AS n FROM steps)
  SELECT worker, count(*) AS n, round(count(*) / sum(seconds), 4) AS throughput, round(avg(seconds) * 1000, 4) AS avg_ms, round(median(seconds) * 1000, 4) AS p50_ms, CASE WHEN count(*) >= 21 THEN round(max(seconds) FILTER (WHERE i = floor(n * 0.95)) * 1000, 4) ELSE 0 END AS p95_ms,
         CASE WHEN count(*) >= 101 THEN round(max(seconds) FILTER (WHERE i = floor(n * 0.99)) * 1000, 4) ELSE 0 END AS p99_ms FROM o GROUP BY worker"""


@query(_LAT)
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.latency_summary(steps(spark, sf_dir), ["worker"])


@query("SELECT event_type AS worker, count(*) AS n, round(count(*) / sum(value / 1000), 4) AS throughput, round(avg(value / 1000) * 1000, 4) AS avg_ms, true AS near_p50, true AS near_p95, true AS near_p99 FROM events GROUP BY 1")
def latency_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches by worker and day, written, merged by worker; whether each percentile's rank is within 2 % of what was asked."""
    log = read(spark, sf_dir, "events").select(F.col("event_type").alias("worker"), F.to_date("ts").alias("day"), (F.col("value") / 1000).alias("seconds"))
    stored = written(evals.latency_sketches(log, ["worker", "day"]), "sketches")
    found = written(evals.latency_of_sketches(stored, ["worker"]), "merged")
    asked = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    ranked = log.select("worker", (F.round(F.col("seconds") * 1000, 4)).alias("ms")).hint("merge").join(found.hint("merge"), "worker")
    share = lambda test: F.avg(test.cast("double"))
    near = [((share(F.col("ms") < F.col(f"{c}_ms")) - 0.02 <= p) & (share(F.col("ms") <= F.col(f"{c}_ms")) + 0.02 >= p)).alias(f"near_{c}") for c, p in asked.items()]
    return ranked.groupBy("worker", "n", "throughput", "avg_ms").agg(*near)


@query("WITH s AS (SELECT l_linenumber AS workers, round(count(*) / sum(l_tax + 0.01), 6) AS throughput FROM lineitem GROUP BY 1) SELECT workers, throughput, round(throughput / first_value(throughput) OVER (ORDER BY workers), 4) AS speedup, round(throughput / first_value(throughput) OVER (ORDER BY workers) / workers * 100, 3) AS efficiency FROM s")
def scaling_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = read(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("workers")).agg(F.round(F.count("*") / F.sum(F.col("l_tax") + 0.01), 6).alias("throughput"))
    return metrics.scaling_efficiency(runs)


@query("SELECT event_type AS shard, count_if(value > 50) AS hits, count_if(value <= 50) AS misses, round(count_if(value > 50) / count(*), 6) AS hit_rate FROM events GROUP BY ROLLUP (event_type)")
def cache_hit_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.cache_hit_stats(read(spark, sf_dir, "events").select(F.col("event_type").alias("shard"), (F.col("value") > 50).alias("hit")))


@query("SELECT l_returnflag AS run, sum(l_linenumber)::BIGINT AS accepted, sum(l_quantity)::BIGINT AS drafted, round(sum(l_linenumber) / sum(l_quantity), 6) AS acceptance_rate, round(4 * sum(l_linenumber) / sum(l_quantity) + 1, 6) AS speedup FROM lineitem GROUP BY 1")
def acceptance_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("run"), F.col("l_linenumber").alias("accepted"), F.col("l_quantity").cast("long").alias("drafted"))
    return metrics.acceptance_stats(log, 4)


@query("SELECT source, count(*) AS n, round(sum(n_chars) / nullif(sum(doc_id % 7), 0), 4) AS tokens_per_second FROM documents GROUP BY 1")
def tokens_per_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.tokens_per_second(read(spark, sf_dir, "documents").select("source", F.col("n_chars").alias("tokens"), (F.col("doc_id") % 7).alias("seconds")), ["source"])


_BEAM = f"WITH {CHATS}, b AS (SELECT conv_id AS problem_id, turn AS idx, round((turn % 3) + CASE WHEN contains(lower(response), 'answer is') OR contains(response, '####') THEN 10 ELSE 0 END - 0.001 * length(response), 6) AS score FROM chats), r AS (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY score DESC, idx) AS rank FROM b)"


@query(f"{_BEAM} SELECT problem_id, idx, score, rank FROM r WHERE rank <= 2")
def beam_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chats(spark, sf_dir).select(F.col("conv_id").alias("problem_id"), F.lit(0).alias("step"), F.col("turn").alias("idx"), (F.col("turn") % 3).alias("previous"), "response")
    return search.beam_prune(rows, 2).select("problem_id", "idx", F.round("score", 6).alias("score"), "rank")


_NODES = "nodes AS (SELECT c_nationkey AS problem_id, c_custkey AS node_id, CASE WHEN c_custkey >= 50 THEN c_custkey // 7 END AS parent_id, c_custkey % 5 AS visits, c_acctbal AS value FROM customer)"


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a search forest: the parent's number is a seventh."""
    c = read(spark, sf_dir, "customer")
    return c.select(F.lit(0).alias("problem_id"), F.col("c_custkey").alias("node_id"), F.when(F.col("c_custkey") >= 50, F.floor(F.col("c_custkey") / 7)).alias("parent_id"), (F.col("c_custkey") % 5).alias("visits"), F.col("c_acctbal").alias("value"))


@query(f"WITH {_NODES}, u AS (SELECT n.node_id, n.parent_id, CASE WHEN n.visits = 0 THEN 'Infinity'::DOUBLE ELSE round(n.value / n.visits + 1.41 * sqrt(ln(greatest(p.visits, 1)) / n.visits), 6) END AS ucb FROM nodes n JOIN nodes p ON n.parent_id = p.node_id), r AS (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY ucb DESC, node_id) AS rank FROM u) SELECT node_id, parent_id, CASE WHEN isinf(ucb) THEN NULL ELSE ucb END AS ucb, rank FROM r")
def ucb_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.ucb_rank(_nodes(spark, sf_dir))
    return found.select("node_id", "parent_id", F.when(F.col("ucb") != float("inf"), F.col("ucb")).alias("ucb"), "rank")


@query(f"WITH RECURSIVE {_NODES}, up AS (SELECT node_id AS leaf, node_id, parent_id, visits, value FROM nodes UNION ALL SELECT up.leaf, p.node_id, p.parent_id, up.visits, up.value FROM up JOIN nodes p ON up.parent_id = p.node_id) SELECT node_id, sum(visits)::BIGINT AS visits, round(sum(value), 4) AS value FROM up GROUP BY 1")
def reward_by_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.reward_by_node(_nodes(spark, sf_dir)).select("node_id", "visits", F.round("value", 4).alias("value"))


@query("WITH q AS (SELECT p_partkey AS query_id, string_split(lower(p_type || ' ' || p_brand || ' ' || p_name), ' ') AS tokens FROM part), s AS (SELECT DISTINCT string_split(lower(p_type || ' ' || p_brand), ' ') AS tokens FROM part WHERE p_size < 10), e AS (SELECT query_id, tokens, unnest(range(1, len(tokens) + 1)) AS n FROM q), m AS (SELECT query_id, max(n) AS hit FROM e JOIN s ON e.tokens[1:n] = s.tokens GROUP BY 1) SELECT query_id, coalesce(hit, 0) AS matched, hit IS NOT NULL AS hit FROM q LEFT JOIN m USING (query_id)")
def longest_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    queries_ = part.select(F.col("p_partkey").alias("query_id"), F.split(F.lower(F.concat_ws(" ", "p_type", "p_brand", "p_name")), " ").alias("tokens"))
    stored = part.where("p_size < 10").select(F.split(F.lower(F.concat_ws(" ", "p_type", "p_brand")), " ").alias("tokens")).distinct()
    return search.longest_prefix_join(queries_, stored)


@query("SELECT doc_id, substr(text, 1, 500) AS response, substr(text, 1, 200) AS preview FROM documents")
def detail_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.detail_truncate(read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("response"), F.col("text").alias("preview")), {"response": 500, "preview": 200})


@query("SELECT l_orderkey, l_linenumber, try_cast(l_returnflag || l_linenumber AS DOUBLE) AS value, coalesce(try_cast(l_returnflag || l_linenumber AS DOUBLE) > 3, false) AS is_correct, CASE WHEN try_cast(l_returnflag || l_linenumber AS DOUBLE) IS NULL THEN 'not a number' END AS error FROM lineitem")
def annotate_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("said"))
    return metrics.annotate_errors(rows, "said").select("l_orderkey", "l_linenumber", "value", F.coalesce(F.col("value") > 3, F.lit(False)).alias("is_correct"), "error")


@query(f"{_FIRST}, n AS (SELECT problem_id, arg_max(ev_answer, votes * 1000 - first_idx) AS answer FROM (SELECT problem_id, pv AS ev_answer, count(*) AS votes, min(sample_idx) AS first_idx FROM graded WHERE pv IS NOT NULL GROUP BY 1, 2) GROUP BY 1), t AS (SELECT problem_id, min(expected)::DOUBLE AS truth FROM graded GROUP BY 1) SELECT 'pass@' || k AS method, count_if(first_correct < k) AS solved FROM p, (VALUES (1), (4), (8)) v(k) GROUP BY k UNION ALL SELECT 'verifier_guided', count(first_correct) FROM p WHERE first_correct < 64 UNION ALL SELECT 'majority', count_if(abs(answer - truth) < 0.001) FROM n JOIN t USING (problem_id)")
def job_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.evaluate(problems(spark, sf_dir), rollouts(spark, sf_dir), KS)


@query(f"WITH {GRADED}, {_PROBLEMS}, p AS (SELECT problem_id, min(sample_idx) FILTER (WHERE is_correct AND sample_idx % 2 = 0) AS a, min(sample_idx) FILTER (WHERE is_correct) AS b FROM problems LEFT JOIN graded USING (problem_id) GROUP BY 1) SELECT 'pass@' || k AS metric, round(count_if(a < k) / 1000, 6) AS base, round(count_if(b < k) / 1000, 6) AS candidate, round((count_if(b < k) - count_if(a < k)) / 10, 4) AS delta FROM p, (VALUES (1), (4)) v(k) GROUP BY k")
def job_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs through the job's files: one has every other sample only."""
    asked, rows = problems(spark, sf_dir), graded(spark, sf_dir).select("problem_id", "sample_idx", "is_correct")
    place = new_path(spark, "compare")
    for run, samples in (("base", rows.where("sample_idx % 2 = 0")), ("candidate", rows)):
        passed = evals.pass_at_k(asked, samples, [1, 4])
        passed.select(F.concat(F.lit("pass@"), F.col("k").cast("string")).alias("method"), F.col("passed").alias("solved")).write.json(f"{place}/{run}")
    jobs.main(["compare", "--base", f"{place}/base", "--candidate", f"{place}/candidate", "--problems", "1000", "--output", f"{place}/report"])
    found = spark.read.schema("metric string, base double, candidate double, delta double").json(f"{place}/report")
    return found.select("metric", F.round("base", 6).alias("base"), F.round("candidate", 6).alias("candidate"), "delta")
