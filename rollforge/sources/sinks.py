"""Writers: samples, result bundles, snapshots, reports, keyed caches, training logs."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollforge.operators.pairs import to_dpo_format
from rollforge.sources.publish import listed, publish, published
from rollforge.sources.readers import LOG_SCHEMA


def write_samples_jsonl(samples: DataFrame, path: str, compression: str | None = None) -> None:
    samples.write.mode("overwrite").json(path, compression=compression)


def write_result_bundle(samples: DataFrame, filtered: DataFrame, raw_pairs: Callable[[], DataFrame] | DataFrame, smart_pairs: DataFrame, stats: DataFrame, path: str, compression: str | None = "gzip") -> None:
    """One run's outputs below path: all, filtered, dpo_pairs, full_pairs, stats, and samples split by correctness.

    The pair table is the ranked pairs if there are any, else the raw ones, which are only made then where they come as
    a function. What is split by correctness is read back from all, so samples are not kept a second time. Texts are
    compressed, which JSON readers undo by the files' names.
    """
    spark = samples.sparkSession
    samples.write.mode("overwrite").json(f"{path}/all", compression=compression)
    back = spark.read.schema(samples.schema).json(f"{path}/all")
    back.withColumn("verdict", F.when(F.col("is_correct"), "correct").otherwise("incorrect")).write.mode("overwrite").partitionBy("verdict").json(f"{path}/by_verdict", compression=compression)
    filtered.write.mode("overwrite").json(f"{path}/filtered", compression=compression)
    smart_pairs.write.mode("overwrite").json(f"{path}/full_pairs", compression=compression)
    pairs = spark.read.schema(smart_pairs.schema).json(f"{path}/full_pairs")
    if pairs.isEmpty():
        raw_pairs = raw_pairs() if callable(raw_pairs) else raw_pairs
        raw_pairs.write.mode("overwrite").json(f"{path}/full_pairs", compression=compression)
        pairs = spark.read.schema(raw_pairs.schema).json(f"{path}/full_pairs")
    to_dpo_format(pairs).write.mode("overwrite").json(f"{path}/dpo_pairs", compression=compression)
    stats.write.mode("overwrite").json(f"{path}/stats")


def publish_result_bundle(samples: DataFrame, filtered: DataFrame, raw_pairs: Callable[[], DataFrame] | DataFrame, smart_pairs: DataFrame, stats: DataFrame, path: str) -> str:
    """A result bundle whose outputs all appear at once; a later bundle of the path replaces it. Gives the bundle's folder."""
    return publish(samples.sparkSession, path, lambda out: write_result_bundle(samples, filtered, raw_pairs, smart_pairs, stats, out), first=False)


def result_bundle(spark: SparkSession, path: str) -> str:
    """The folder of the newest whole bundle that was published below path."""
    found = published(spark, path, first=False)
    if found is None:
        raise FileNotFoundError(f"no finished bundle in {path}")
    return found


def append_snapshot(samples: DataFrame, path: str, step: int) -> None:
    """The rows of one checkpoint step; writing a step again replaces it, at once for every reader."""
    rows = samples.withColumn("step", F.lit(step))
    publish(samples.sparkSession, f"{path}/{step:010d}", lambda out: rows.write.parquet(out), first=False)


def snapshot(spark: SparkSession, path: str, step: int) -> DataFrame:
    """Everything up to a step, with the step of each row; later steps are not read."""
    upto = [name for _, name in listed(spark, path) if int(name) <= step]
    folders = [found for name in sorted(upto) if (found := published(spark, f"{path}/{name}", first=False))]
    if not folders:
        raise FileNotFoundError(f"no step up to {step} in {path}")
    return spark.read.parquet(*folders)


def eval_report(summary: DataFrame, details: DataFrame, by: list[str]) -> DataFrame:
    """A row per summary with its details as JSON, for reports of bounded size."""
    held = details.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*[c for c in details.columns if c not in by]))).alias("details"))
    return summary.join(held, by, "left").select(*by, F.to_json(F.struct(*[c for c in summary.columns if c not in by], "details")).alias("report"))


def preference_cache(spark: SparkSession, root: str, key: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """The table made for a key: read if one was finished, else made and written. Of two makers the first one's counts."""
    path = f"{root}/pairs-{hashlib.sha256(json.dumps(key, sort_keys=True).encode()).hexdigest()[:16]}"
    return spark.read.parquet(published(spark, path) or publish(spark, path, lambda out: make().write.parquet(out)))


def append_training_log(rows: DataFrame, path: str) -> None:
    spark = rows.sparkSession
    wanted = spark.createDataFrame([], LOG_SCHEMA).columns
    rows.select(*[c for c in wanted if c in rows.columns]).write.mode("append").json(path)
