"""Benchmarks, samples and logs as DataFrames with explicit schemas.

Rows have no order in Spark, so readers that depend on one add it: by the files' own idx or sample_idx columns where
they have them, else by read_at, the place in the files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollforge.functions.text import strip

SAMPLE_SCHEMA = "problem_id string, sample_idx int, problem string, reasoning string, final_answer string, expected_answer string, is_correct boolean, verification_confidence double, path_hash string"
PAIR_SCHEMA = "problem_id string, prompt string, chosen string, rejected string, diversity_score double, chosen_confidence double, rejected_confidence double"
LOG_SCHEMA = "step long, epoch double, loss double, policy_loss double, kl_divergence double, reward_margin double, gradient_norm double, learning_rate double, ratio_mean double, timestamp double"


def last_marked(answer: Column | str) -> Column:
    """Text after the last ####, trimmed; the whole text without one."""
    return strip(F.try_element_at(F.split(F.col(answer) if isinstance(answer, str) else answer, "####"), F.lit(-1)))


def subset_prefix(df: DataFrame, n: int | None, ordinal: str = "problem_idx") -> DataFrame:
    """The first n problems by their ordinal; a filter, not a sort."""
    return df if n is None else df.where(F.col(ordinal) < n)


def difficulty_subject(df: DataFrame, level: str | None = None, subject: str | None = None) -> DataFrame:
    """Equality predicates on level and type, which Parquet scans take over."""
    df = df if level is None else df.where(F.col("level") == level)
    return df if subject is None else df.where(F.col("type") == subject)


def gsm8k(rows: DataFrame, split: str = "train", subset: int | None = None) -> DataFrame:
    """Rows (idx, question, answer) as problems: the text after ####, without commas, else the last line."""
    parts, lines = F.split("answer", "####"), F.split("answer", "\n")
    marked = F.replace(strip(F.try_element_at(parts, F.lit(-1))), F.lit(","), F.lit(""))
    answer = F.when(F.size(parts) > 1, marked).otherwise(strip(F.try_element_at(lines, F.lit(-1))))
    out = rows.select(
        F.concat(F.lit(f"gsm8k_{split}_"), F.col("idx").cast("string")).alias("id"), F.col("idx").cast("long").alias("problem_idx"), F.col("question").alias("problem"), answer.alias("answer"),
        F.struct(F.lit("gsm8k").alias("dataset"), F.lit(split).alias("split"), F.col("answer").alias("full_solution")).alias("metadata"),
    )
    return subset_prefix(out, subset)


def humaneval(rows: DataFrame, subset: int | None = None) -> DataFrame:
    """Rows (idx, task_id, prompt, canonical_solution, entry_point, test) as problems."""
    out = rows.select(F.col("task_id").alias("id"), F.col("idx").cast("long").alias("problem_idx"), F.col("prompt").alias("problem"), F.col("canonical_solution").alias("answer"), F.struct(F.lit("humaneval").alias("dataset"), "entry_point", "test").alias("metadata"))
    return subset_prefix(out, subset)


def mbpp(rows: DataFrame, subset: int | None = None) -> DataFrame:
    """Rows (idx, task_id, text, code, test_list, challenge_test_list) as problems; test_code joins the tests by lines."""
    none = F.array().cast("array<string>")
    meta = F.struct(F.lit("mbpp").alias("dataset"), F.array_join(F.coalesce("test_list", none), "\n").alias("test_code"), F.coalesce("challenge_test_list", none).alias("challenge_tests"))
    out = rows.select(F.concat(F.lit("mbpp_"), F.col("task_id").cast("string")).alias("id"), F.col("idx").cast("long").alias("problem_idx"), F.col("text").alias("problem"), F.col("code").alias("answer"), meta.alias("metadata"))
    return subset_prefix(out, subset)


def math(rows: DataFrame, split: str = "train", level: str | None = None, subject: str | None = None, subset: int | None = None, limit_after_filter: bool = False) -> DataFrame:
    """Rows (idx, problem, solution, level, type) as problems. A subset limits the rows looked at, before the filters."""
    if not limit_after_filter:
        rows = subset_prefix(rows, subset, "idx")
    rows = difficulty_subject(rows, level, subject)
    answer = F.regexp_extract("solution", r"\\boxed\{([^}]+)\}", 1)
    out = rows.select(
        F.concat(F.lit(f"math_{split}_"), F.col("idx").cast("string")).alias("id"), F.col("idx").cast("long").alias("problem_idx"), "problem", answer.alias("answer"),
        F.struct(F.lit("math").alias("dataset"), F.lit(split).alias("split"), "level", "type", F.col("solution").alias("full_solution")).alias("metadata"),
    )
    return out.orderBy("problem_idx").limit(subset) if limit_after_filter and subset is not None else out


BENCHMARKS = {"gsm8k": gsm8k, "humaneval": humaneval, "mbpp": mbpp, "math": math}


def benchmark(name: str, rows: DataFrame, **options) -> DataFrame:
    """A benchmark's rows as problems, by its name in any case."""
    if name.lower() not in BENCHMARKS:
        raise ValueError(f"unknown benchmark {name!r}; there are {sorted(BENCHMARKS)}")
    return BENCHMARKS[name.lower()](rows, **options)


def first_source(spark: SparkSession, paths: list[str], schema: str, fmt: str = "json") -> DataFrame:
    """The first of several places that can be read."""
    from pyspark.errors import AnalysisException

    missed: Exception | None = None
    for path in paths:
        try:
            return spark.read.schema(schema).format(fmt).load(path)
        except AnalysisException as error:
            missed = error
    raise FileNotFoundError(f"none of {paths} can be read") from missed


def eval_set(rows: DataFrame, whole_solution: bool = False) -> DataFrame:
    """prompt and answer: the last #### part, or the whole solution for competition problems."""
    return rows.select(F.col("question").alias("prompt"), (F.col("answer") if whole_solution else last_marked("answer")).alias("answer"))


def split_union(**splits: DataFrame) -> DataFrame:
    """Several splits in one table, each row with its split's name."""
    from functools import reduce

    return reduce(DataFrame.unionByName, [df.withColumn("split", F.lit(name)) for name, df in splits.items()])


def samples_jsonl(spark: SparkSession, path: str, schema: str = SAMPLE_SCHEMA) -> DataFrame:
    """One object per line; lines that are no JSON end up in _corrupt_record with nulls elsewhere."""
    return spark.read.schema(schema + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def samples_in_order(spark: SparkSession, path: str) -> DataFrame:
    """Samples with reading order: problem_id from id, reasoning from response where missing, and read_at. Lines that are no JSON are left out."""
    raw = samples_jsonl(spark, path, SAMPLE_SCHEMA + ", id string, prompt string, response string")
    read_at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), F.monotonically_increasing_id().alias("nth"))
    rows = raw.select("*", read_at.alias("read_at")).where(F.col("_corrupt_record").isNull())
    first = lambda *names: F.coalesce(*names, F.lit(""))
    rows = rows.withColumns({"problem_id": first("problem_id", "id"), "reasoning": first("reasoning", "response"), "problem": first("problem", "prompt")})
    return rows.drop("_corrupt_record", "id", "response", "prompt")


def samples_json_or_jsonl(spark: SparkSession, path: str, schema: str = SAMPLE_SCHEMA) -> DataFrame:
    """.json holds one array, anything else a row per line; keeps correct rows, a missing flag counts as correct."""
    rows = spark.read.schema(schema).option("multiLine", path.rstrip("/").endswith(".json")).json(path)
    return rows.where(F.coalesce("is_correct", F.lit(True)))


def pairs_required_keys(spark: SparkSession, path: str) -> DataFrame:
    """Pairs with prompt, chosen and rejected; a null counts as missing."""
    return spark.read.schema(PAIR_SCHEMA).json(path).dropna(subset=["prompt", "chosen", "rejected"])


def training_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).json(path)
