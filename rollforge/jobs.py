"""spark-submit entry points: python -m rollforge.jobs preprocess|generate|evaluate|compare|pipeline ..."""

from __future__ import annotations

import argparse
from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollforge.functions import hooks
from rollforge.operators import clean, encode, evals, grading, metrics, pairs
from rollforge.sources import readers, sinks
from rollforge.sources.scratch import remove, written

IN_ORDER = ["sample_idx", "read_at"]
PROBLEMS = "id string, problem string, answer string"
STORED = "problem_id string, sample_idx long, reasoning string, expected string"


def preprocess_jsonl(spark: SparkSession, source: str, out: str, pairs_out: str | None = None, config: clean.Config = clean.Config()) -> DataFrame:
    """File to file: cleaned samples, and ranked pairs of them if asked. Gives the run's counts (name, n).

    Files need neither problem_id nor sample_idx: id stands in for the one, the reading order for the other.
    """
    kept, counts = clean.preprocess_counted(readers.samples_in_order(spark, source), config, IN_ORDER)
    sinks.write_samples_jsonl(kept.drop("read_at"), out)
    remove(kept)
    if not pairs_out:
        return counts
    made = pairs.smart_pair_join(spark.read.schema(kept.drop("read_at").schema).json(out), config.min_diversity, config.max_pairs)
    made.write.mode("overwrite").json(pairs_out)
    remove(made)
    return counts.unionByName(spark.read.schema(made.schema).json(pairs_out).agg(F.count("*").alias("n")).select(F.lit("pairs_created").alias("name"), "n"))


def generate(spark: SparkSession, problems: DataFrame, make: Callable, paths: int, out: str, config: clean.Config = clean.Config()) -> None:
    """Problems to a result bundle: fan out, generate by the user's function, grade, clean, pair.

    Problems are small and their texts are not: files of fewer splits than there are cores are dealt out before.
    """
    cores = spark.sparkContext.defaultParallelism
    problems = problems.repartition(2 * cores, "id") if problems.rdd.getNumPartitions() < cores else problems
    asked = encode.fan_out_paths(problems.select(F.col("id").alias("problem_id"), "problem", F.col("answer").alias("expected"), encode.format_prompt("problem").alias("prompt")), paths)
    said = hooks.generator_hook(asked, make)
    # texts are generated once: every later step reads them back
    said.write.mode("overwrite").parquet(f"{out}/generated")
    rows = spark.read.schema(said.schema).parquet(f"{out}/generated").drop("prompt")
    graded = grading.verify_batch(rows).withColumn("confidence", F.col("verification_confidence"))
    cleaned = clean.preprocess(graded, config)
    sinks.write_result_bundle(graded, cleaned, lambda: pairs.pair_join(graded), pairs.smart_pair_join(cleaned, config.min_diversity, config.max_pairs), metrics.generation_stats(graded), out)


def evaluate(problems: DataFrame, samples: DataFrame, ks: list[int]) -> DataFrame:
    """method, solved over stored samples (problem_id, sample_idx, reasoning, expected): pass@k, budget, majority.

    Verdicts are written, so that no method grades anew.
    """
    graded = written(grading.verify_batch(samples).select("problem_id", "sample_idx", "is_correct", "final_answer", "expected"), "graded")
    passed = evals.pass_at_k(problems, graded, ks).select(F.concat(F.lit("pass@"), F.col("k").cast("string")).alias("method"), F.col("passed").alias("solved"))
    budget = evals.verifier_guided_budget(problems, graded).agg(F.count_if("solved").alias("solved")).select(F.lit("verifier_guided").alias("method"), "solved")
    votes = evals.majority_vote(graded.select("problem_id", "sample_idx", F.col("final_answer").alias("answer"), F.lit(1.0).alias("score")))
    truth = graded.groupBy("problem_id").agg(F.min("expected").try_cast("double").alias("truth"))
    majority = votes.join(truth, "problem_id").agg(F.count_if(F.abs(F.col("answer") - F.col("truth")) < 0.001).alias("solved")).select(F.lit("majority").alias("method"), "solved")
    return passed.unionByName(budget).unionByName(majority)


def compare(base: DataFrame, candidate: DataFrame, problems: int) -> DataFrame:
    """Two evaluations (method, solved) side by side, in shares and points."""
    runs = base.withColumn("run", F.lit("base")).unionByName(candidate.withColumn("run", F.lit("candidate")))
    return evals.compare_runs(runs.select("run", F.col("method").alias("metric"), (F.col("solved") / problems).alias("value")), "base", "candidate")


def training_files(spark: SparkSession, samples: str, pairs_path: str, out: str) -> None:
    """What a trainer takes over: prompt and completion of correct samples, and prompt, chosen and rejected of pairs."""
    encode.to_sft_format(readers.samples_jsonl(spark, samples)).write.mode("overwrite").json(f"{out}/sft")
    pairs.to_dpo_format(readers.pairs_required_keys(spark, pairs_path)).write.mode("overwrite").json(f"{out}/dpo")


def loaded(name: str) -> Callable:
    """The function that "module:function" names."""
    module, _, function = name.partition(":")
    return getattr(import_module(module), function)


def read_problems(spark: SparkSession, path: str, most: int | None) -> DataFrame:
    rows = spark.read.schema(PROBLEMS).json(path)
    return rows if most is None else rows.orderBy("id").limit(most)


def run_pipeline(spark: SparkSession, found: argparse.Namespace) -> None:
    """Phases with skips: generate, or go on from samples that are there; clean and pair; hand over to training; evaluate."""
    samples = found.samples or f"{found.output}/all"
    if not found.samples and not found.skip_generation:
        generate(spark, read_problems(spark, found.problems, found.subset_size), loaded(found.generator), found.num_paths, found.output)
    if not found.skip_preprocess:
        counts = preprocess_jsonl(spark, samples, f"{found.output}/samples", f"{found.output}/pairs")
        counts.write.mode("overwrite").json(f"{found.output}/counts")
    if not found.skip_training_files:
        training_files(spark, f"{found.output}/samples", f"{found.output}/pairs", f"{found.output}")
    if not found.skip_eval:
        wanted = STORED.replace("expected string", "expected string, expected_answer string")
        rows = spark.read.schema(wanted).json(samples).select("problem_id", "sample_idx", "reasoning", F.coalesce("expected", "expected_answer").alias("expected"))
        evaluate(rows.select("problem_id").distinct(), rows, found.k).write.mode("overwrite").json(f"{found.output}/evaluation")


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="rollforge")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("preprocess")
    one.add_argument("--input", required=True)
    one.add_argument("--output", required=True)
    one.add_argument("--pairs-output")
    one.add_argument("--min-length", type=int, default=clean.Config.min_chars)
    one.add_argument("--max-length", type=int, default=clean.Config.max_chars)
    one.add_argument("--dedup-threshold", type=float, default=clean.Config.dedup_threshold)
    making = argparse.ArgumentParser(add_help=False)
    making.add_argument("--problems", help="JSON lines with id, problem and answer")
    making.add_argument("--generator", help="module:function that makes a function from prompts to texts")
    making.add_argument("--num-paths", type=int, default=10)
    making.add_argument("--subset-size", type=int)
    making.add_argument("--output", required=True)
    commands.add_parser("generate", parents=[making])
    two = commands.add_parser("evaluate")
    two.add_argument("--samples", required=True)
    two.add_argument("--output", required=True)
    two.add_argument("--k", type=int, nargs="+", default=[1, 4, 8])
    three = commands.add_parser("compare")
    three.add_argument("--base", required=True)
    three.add_argument("--candidate", required=True)
    three.add_argument("--problems", type=int, required=True)
    three.add_argument("--output", required=True)
    four = commands.add_parser("pipeline", parents=[making])
    four.add_argument("--samples", help="go on from these samples (JSON lines) instead of generating")
    four.add_argument("--k", type=int, nargs="+", default=[1, 4, 8])
    for phase in ("generation", "preprocess", "training-files", "eval"):
        four.add_argument(f"--skip-{phase}", action="store_true")
    found = parser.parse_args(args)
    # generated methods over 8000 bytes are never compiled by the JVM; such stages run faster as separate expressions
    spark = SparkSession.builder.appName(f"rollforge {found.command}").config("spark.sql.codegen.hugeMethodLimit", "8000").getOrCreate()
    if found.command == "preprocess":
        config = clean.Config(min_chars=found.min_length, max_chars=found.max_length, dedup_threshold=found.dedup_threshold)
        preprocess_jsonl(spark, found.input, found.output, found.pairs_output, config).write.mode("overwrite").json(f"{found.output}-stats")
    elif found.command == "generate":
        generate(spark, read_problems(spark, found.problems, found.subset_size), loaded(found.generator), found.num_paths, found.output)
    elif found.command == "evaluate":
        samples = spark.read.schema(STORED).json(found.samples)
        evaluate(samples.select("problem_id").distinct(), samples, found.k).write.mode("overwrite").json(found.output)
    elif found.command == "compare":
        read = lambda path: spark.read.schema("method string, solved long").json(path)
        compare(read(found.base), read(found.candidate), found.problems).write.mode("overwrite").json(found.output)
    else:
        run_pipeline(spark, found)


if __name__ == "__main__":
    main()
