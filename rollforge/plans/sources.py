"""Source and sink queries: tables are written to the session's shared folder in the formats that jobs exchange."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollforge import jobs
from rollforge.operators import clean, metrics, pairs
from rollforge.plans.derived import ANSWERS, answers, read
from rollforge.plans.grading import GRADED, graded
from rollforge.plans.cleaning import CLEANED, SMART_OF_CLEANED, samples
from rollforge.plans.pairing import _SMART
from rollforge.plans.registry import query
from rollforge.sources import readers, sinks
from rollforge.sources.scratch import new_path, written


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as grade-school questions; every third answer has no ####."""
    o = read(spark, sf_dir, "orders")
    total = F.floor("o_totalprice").cast("string")
    answer = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Add up.\n"), total)).otherwise(F.concat(F.lit("Add up.\n#### 1,"), total))
    return o.select(F.col("o_orderkey").alias("idx"), F.concat(F.lit("What does customer "), F.col("o_custkey").cast("string"), F.lit(" pay?")).alias("question"), answer.alias("answer"))


_ANSWER = "CASE WHEN o_orderkey % 3 = 0 THEN 'Add up.' || chr(10) || floor(o_totalprice)::BIGINT ELSE 'Add up.' || chr(10) || '#### 1,' || floor(o_totalprice)::BIGINT END"


@query(f"SELECT 'gsm8k_train_' || o_orderkey AS id, o_orderkey AS problem_idx, 'What does customer ' || o_custkey || ' pay?' AS problem, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '1' END || floor(o_totalprice)::BIGINT AS answer, {_ANSWER} AS full_solution FROM orders WHERE o_orderkey < 1000000000")
def read_gsm8k(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "gsm8k")
    _questions(spark, sf_dir).write.json(path)
    rows = spark.read.schema("idx long, question string, answer string").json(path)
    return readers.gsm8k(rows, "train").select("id", "problem_idx", "problem", "answer", "metadata.full_solution")


@query("SELECT 'T/' || p_partkey AS id, p_partkey AS problem_idx, p_name AS problem, 'return ' || p_size AS answer, 'f' AS entry_point, 'assert f()' AS test FROM part")
def read_humaneval(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    rows = p.select(F.col("p_partkey").alias("idx"), F.concat(F.lit("T/"), F.col("p_partkey").cast("string")).alias("task_id"), F.col("p_name").alias("prompt"), F.concat(F.lit("return "), F.col("p_size").cast("string")).alias("canonical_solution"), F.lit("f").alias("entry_point"), F.lit("assert f()").alias("test"))
    return readers.humaneval(rows).select("id", "problem_idx", "problem", "answer", "metadata.entry_point", "metadata.test")


@query("SELECT 'mbpp_' || p_partkey AS id, p_partkey AS problem_idx, p_name AS problem, p_type AS answer, 'assert 1' || chr(10) || 'assert ' || p_size AS test_code, 0::BIGINT AS challenges FROM part")
def read_mbpp(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    tests = F.array(F.lit("assert 1"), F.concat(F.lit("assert "), F.col("p_size").cast("string")))
    rows = p.select(F.col("p_partkey").alias("idx"), F.col("p_partkey").alias("task_id"), F.col("p_name").alias("text"), F.col("p_type").alias("code"), tests.alias("test_list"), F.lit(None).cast("array<string>").alias("challenge_test_list"))
    return readers.mbpp(rows).select("id", "problem_idx", "problem", "answer", "metadata.test_code", F.size("metadata.challenge_tests").cast("long").alias("challenges"))


_MATH = "SELECT 'math_train_' || o_orderkey AS id, o_orderkey AS problem_idx, o_custkey::VARCHAR AS problem, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey::VARCHAR ELSE '' END AS answer FROM orders WHERE o_orderpriority = (SELECT min(o_orderpriority) FROM orders) AND o_orderstatus = 'F'"


@query(_MATH)
def read_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as competition problems: every row of the least priority with status F."""
    o = read(spark, sf_dir, "orders")
    least = o.agg(F.min("o_orderpriority")).first()[0]
    text = F.col("o_custkey").cast("string")
    solution = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("so \\boxed{"), text, F.lit("}"))).otherwise("unknown")
    rows = o.select(F.col("o_orderkey").alias("idx"), text.alias("problem"), solution.alias("solution"), F.col("o_orderpriority").alias("level"), F.col("o_orderstatus").alias("type"))
    return readers.math(rows, "train", level=least, subject="F").select("id", "problem_idx", "problem", "answer")


@query(_MATH)
def read_math_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same reader by the benchmark's name."""
    return read_math(spark, sf_dir)


@query("SELECT 'math_train_' || o_orderkey AS id, o_orderkey AS problem_idx, o_custkey::VARCHAR AS problem FROM orders")
def read_math_first_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reader over three places in order, of which only the last is there."""
    path, o = new_path(spark, "math"), read(spark, sf_dir, "orders")
    text = F.col("o_custkey").cast("string")
    o.select(F.col("o_orderkey").alias("idx"), text.alias("problem"), F.lit("so 1").alias("solution"), F.col("o_orderpriority").alias("level"), F.col("o_orderstatus").alias("type")).write.json(f"{path}/third")
    rows = readers.first_source(spark, [f"{path}/first", f"{path}/second", f"{path}/third"], "idx long, problem string, solution string, level string, type string")
    return readers.math(rows, "train").select("id", "problem_idx", "problem")


@query("SELECT 'gsm8k_test_' || o_orderkey AS id FROM orders")
def read_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.benchmark("GSM8K", _questions(spark, sf_dir), split="test").select("id")


@query(f"SELECT 'What does customer ' || o_custkey || ' pay?' AS prompt, trim(string_split({_ANSWER}, '####')[-1]) AS answer FROM orders")
def load_eval_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.eval_set(_questions(spark, sf_dir))


@query("SELECT 'train' AS split, o_orderkey AS idx FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'test', o_orderkey FROM orders WHERE o_orderkey % 2 = 1")
def split_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _questions(spark, sf_dir)
    return readers.split_union(train=q.where("idx % 2 = 0"), test=q.where("idx % 2 = 1")).select("split", "idx")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey < 700")
def subset_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator is the limit: problems by their ordinal."""
    return readers.subset_prefix(read(spark, sf_dir, "orders").select("o_orderkey"), 700, "o_orderkey")


def _written(spark: SparkSession, sf_dir: str) -> str:
    path = new_path(spark, "samples")
    rows = answers(spark, sf_dir).select("problem_id", "sample_idx", "problem", "reasoning", F.when(F.col("sample_idx") % 5 != 0, F.col("is_correct")).alias("is_correct"))
    sinks.write_samples_jsonl(rows, path)
    return path


@query(f"WITH {ANSWERS} SELECT problem_id, sample_idx, reasoning, CASE WHEN sample_idx % 5 <> 0 THEN is_correct END AS is_correct FROM answers")
def read_samples_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.samples_jsonl(spark, _written(spark, sf_dir)).select("problem_id", F.col("sample_idx").cast("long").alias("sample_idx"), "reasoning", "is_correct")


@query(f"WITH {ANSWERS} SELECT problem_id, sample_idx FROM answers WHERE sample_idx % 5 = 0 OR is_correct")
def read_samples_json_or_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.samples_json_or_jsonl(spark, _written(spark, sf_dir)).select("problem_id", F.col("sample_idx").cast("long").alias("sample_idx"))


@query(f"WITH {ANSWERS} SELECT count(*) AS n, sum(length(reasoning))::BIGINT AS chars FROM answers")
def write_samples_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.samples_jsonl(spark, _written(spark, sf_dir)).agg(F.count("*").alias("n"), F.sum(F.length("reasoning")).alias("chars"))


@query(f"WITH {ANSWERS} SELECT problem AS prompt, reasoning AS chosen FROM answers WHERE sample_idx % 3 <> 0")
def read_pairs_required_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "pairs")
    rows = answers(spark, sf_dir).select(F.col("problem").alias("prompt"), F.col("reasoning").alias("chosen"), F.when(F.col("sample_idx") % 3 != 0, "no").alias("rejected"))
    rows.write.json(path)
    return readers.pairs_required_keys(spark, path).select("prompt", "chosen")


@query(f"WITH RECURSIVE {CLEANED}, {SMART_OF_CLEANED} SELECT 'all' AS part, (SELECT count(*) FROM samples) AS n, NULL::VARCHAR AS texts UNION ALL SELECT 'correct', (SELECT count_if(is_correct) FROM samples), NULL UNION ALL SELECT 'incorrect', (SELECT count_if(NOT is_correct) FROM samples), NULL UNION ALL SELECT 'filtered', (SELECT count(*) FROM cleaned), NULL UNION ALL SELECT 'dpo_pairs', count(*), md5(string_agg(md5(prompt || chosen || rejected), '' ORDER BY md5(prompt || chosen || rejected))) FROM csmart UNION ALL SELECT 'full_pairs', count(*), NULL FROM csmart UNION ALL SELECT 'stats', 1, NULL")
def write_result_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each output of a run, read back, and a digest of the preference texts."""
    path, rows = new_path(spark, "bundle"), samples(spark, sf_dir)
    cleaned = clean.preprocess(rows)
    sinks.publish_result_bundle(rows, cleaned, lambda: pairs.pair_join(rows), pairs.smart_pair_join(cleaned), metrics.generation_stats(rows), path)
    path = sinks.result_bundle(spark, path)
    sized = lambda part, df: df.agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "n", F.lit(None).cast("string").alias("texts"))
    split = spark.read.json(f"{path}/by_verdict")
    parts = [sized(p, spark.read.json(f"{path}/{p}")) for p in ("all", "filtered", "full_pairs", "stats")]
    parts += [sized(v, split.where(F.col("verdict") == v)) for v in ("correct", "incorrect")]
    marks = spark.read.schema("prompt string, chosen string, rejected string").json(f"{path}/dpo_pairs").select(F.md5(F.concat("prompt", "chosen", "rejected")).alias("m"))
    parts.append(marks.agg(F.count("*").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("m")), "")).alias("texts")).select(F.lit("dpo_pairs").alias("part"), "n", "texts"))
    return reduce(DataFrame.unionByName, parts)


@query("SELECT o_orderpriority AS step_name, count(*) AS n FROM orders WHERE o_orderpriority <= '3-MEDIUM' GROUP BY 1")
def checkpoint_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps are order priorities; the snapshot holds the first three."""
    path = new_path(spark, "snapshots")
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("step_name"), F.substring("o_orderpriority", 1, 1).cast("int").alias("step"))
    for step in range(1, 6):
        sinks.append_snapshot(o.where(F.col("step") == step), path, step)
    return sinks.snapshot(spark, path, 3).groupBy("step_name").agg(F.count("*").alias("n"))


@query(f"WITH {GRADED}, s AS (SELECT problem_id, count(*) AS n, count_if(is_correct) AS correct FROM graded GROUP BY 1) SELECT problem_id, n, correct, n AS details FROM s")
def write_eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(graded(spark, sf_dir).select("problem_id", "sample_idx", "is_correct"), "graded")
    summary = rows.groupBy("problem_id").agg(F.count("*").alias("n"), F.count_if("is_correct").alias("correct"))
    path = new_path(spark, "report")
    sinks.eval_report(summary, rows, ["problem_id"]).write.json(path)
    back = spark.read.json(path).withColumn("r", F.from_json("report", "n long, correct long, details array<struct<sample_idx:long,is_correct:boolean>>"))
    return back.select("problem_id", "r.n", "r.correct", F.size("r.details").cast("long").alias("details"))


@query(f"WITH {_SMART} SELECT problem_id, c_idx, r_idx FROM smart WHERE rank <= 5")
def preference_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, key = new_path(spark, "cache"), {"dataset": "rollouts", "n": 5}
    make = lambda: pairs.smart_pair_join(graded(spark, sf_dir))
    sinks.preference_cache(spark, root, key, make)
    return sinks.preference_cache(spark, root, key, make).select("problem_id", "c_idx", "r_idx")


@query("SELECT event_id AS step, value AS loss FROM events", name="append_training_log")
def append_and_read_training_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, log = new_path(spark, "log"), read(spark, sf_dir, "events").select(F.col("event_id").alias("step"), F.col("value").alias("loss"))
    sinks.append_training_log(log.where("step % 2 = 0"), path)
    sinks.append_training_log(log.where("step % 2 = 1"), path)
    return readers.training_log(spark, path).select("step", "loss")


@query("SELECT event_id AS step, round(value, 6) AS loss, round(value - 50, 6) AS reward_margin, round((user_id % 10) / 10.0, 6)::DOUBLE AS kl_divergence, NULL::DOUBLE AS ratio_mean FROM events")
def read_training_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log's rows by its schema; fields that a run did not write are null."""
    path, e = new_path(spark, "log"), read(spark, sf_dir, "events")
    sinks.append_training_log(e.select(F.col("event_id").alias("step"), F.col("value").alias("loss"), (F.col("value") - 50).alias("reward_margin"), (F.col("user_id") % 10 / 10.0).alias("kl_divergence"), F.lit("x").alias("note")), path)
    found = readers.training_log(spark, path)
    return found.select("step", *[F.round(c, 6).alias(c) for c in ("loss", "reward_margin", "kl_divergence", "ratio_mean")])


@query(f"WITH {ANSWERS} SELECT problem_id, count(*) AS n FROM answers GROUP BY 1")
def collect_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches appended to one table."""
    path, rows = new_path(spark, "datasets"), answers(spark, sf_dir).select("problem_id", "sample_idx", "is_correct")
    rows.where("is_correct").write.mode("append").parquet(path)
    rows.where("not is_correct").write.mode("append").parquet(path)
    return spark.read.parquet(path).groupBy("problem_id").agg(F.count("*").alias("n"))


def echo():
    """A stand-in generator: texts that pass cleaning. A prompt's first text ends in 0, the next one in 1, and so on."""
    times: dict[str, int] = {}

    def say(prompt: str) -> str:
        n = times[prompt] = times.get(prompt, -1) + 1
        return "Step 1: read the question. Step 2: think. " + " ".join(f"word{n}x{i}" for i in range(60)) + f"\n#### {n}"

    return lambda prompts: [say(p) for p in prompts]


@query("WITH p AS (SELECT 2 * count(*) AS texts, count_if(p_size % 7 < 2) AS solved FROM part) SELECT 'all' AS part, texts AS n FROM p UNION ALL SELECT 'filtered', texts FROM p UNION ALL SELECT 'correct', solved FROM p UNION ALL SELECT 'full_pairs', solved FROM p UNION ALL SELECT 'dpo_pairs', solved FROM p UNION ALL SELECT 'stats', 1")
def job_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as problems through the whole command: two paths each, one of which is right where the answer is 0 or 1."""
    path, p = new_path(spark, "job"), read(spark, sf_dir, "part")
    named = p.select(F.col("p_partkey").cast("string").alias("id"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("problem"), (F.col("p_size") % 7).cast("string").alias("answer"))
    named.write.json(f"{path}/problems")
    jobs.main(["generate", "--problems", f"{path}/problems", "--generator", "rollforge.plans.sources:echo", "--num-paths", "2", "--output", path])
    sized = lambda part, df: df.agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "n")
    parts = [sized(part, spark.read.json(f"{path}/{part}")) for part in ("all", "filtered", "full_pairs", "dpo_pairs", "stats")]
    parts.append(sized("correct", spark.read.json(f"{path}/all").where("is_correct")))
    return reduce(DataFrame.unionByName, parts)


def _samples_file(spark: SparkSession, sf_dir: str) -> str:
    """Samples as a run's compressed files, with the expected answer of the rows that end in one."""
    path = new_path(spark, "run")
    rows = samples(spark, sf_dir).withColumnRenamed("confidence", "verification_confidence")
    sinks.write_samples_jsonl(rows.select("problem_id", "sample_idx", "problem", "reasoning", "is_correct", "verification_confidence", F.lit("42").alias("expected_answer")), f"{path}/in", "gzip")
    return path


@query(f"WITH RECURSIVE {CLEANED}, {SMART_OF_CLEANED} SELECT 'input_samples' AS name, count(*) AS n FROM samples UNION ALL SELECT 'filtered_' || coalesce(quality_reason, length_reason), count(*) FROM marked WHERE coalesce(quality_reason, length_reason) IS NOT NULL GROUP BY 1 UNION ALL SELECT 'dedup_removed', (SELECT count(*) FROM passed) - (SELECT count(*) FROM cleaned) UNION ALL SELECT 'output_samples', count(*) FROM cleaned UNION ALL SELECT 'pairs_created', count(*) FROM csmart")
def preprocess_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File to file: the run's counts."""
    path = _samples_file(spark, sf_dir)
    return jobs.preprocess_jsonl(spark, f"{path}/in", f"{path}/samples", f"{path}/pairs")


@query(f"WITH RECURSIVE {CLEANED} SELECT problem_id, sample_idx, t AS reasoning FROM cleaned")
def job_preprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The command's output rows, read back."""
    path = _samples_file(spark, sf_dir)
    jobs.main(["preprocess", "--input", f"{path}/in", "--output", f"{path}/samples"])
    return spark.read.schema("problem_id string, sample_idx long, reasoning string").json(f"{path}/samples")


@query(f"WITH RECURSIVE {CLEANED}, {SMART_OF_CLEANED} SELECT 'samples' AS part, count(*) AS n FROM cleaned UNION ALL SELECT 'sft', count_if(is_correct) FROM cleaned UNION ALL SELECT 'pairs', count(*) FROM csmart UNION ALL SELECT 'dpo', count(*) FROM csmart UNION ALL SELECT 'evaluation', 5")
def job_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each output of the command that goes on from existing samples: cleaned, paired, handed over, evaluated."""
    path = _samples_file(spark, sf_dir)
    jobs.main(["pipeline", "--samples", f"{path}/in", "--output", path])
    sized = lambda part: spark.read.json(f"{path}/{part}").agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "n")
    return reduce(DataFrame.unionByName, map(sized, ("samples", "sft", "pairs", "dpo", "evaluation")))
