"""Streaming stages. Each is a function of DataFrames, so a batch table goes through the same code as a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from rollforge.functions.hooks import processor_hook
from rollforge.functions.text import path_hash
from rollforge.operators.grading import verify_batch
from rollforge.streaming.envelopes import chosen_late, unwrap

PATH = "problem_id string, sample_idx long, reasoning string, expected string"


def stream_verify(messages: DataFrame) -> DataFrame:
    """Raw paths, graded, as messages for the verified topic; broken messages and paths without text are dropped."""
    data = lambda _: F.struct("problem_id", "sample_idx", "reasoning", "is_correct", "verification_confidence")
    return processor_hook(PATH, lambda rows: verify_batch(rows.where(F.col("reasoning").isNotNull())), data, "verified")(messages)


def verify_once(messages: DataFrame, late: str = "10 minutes") -> DataFrame:
    """stream_verify for topics that may deliver a path again: the first of equal paths counts, by problem and text.

    A path is remembered until the watermark, which trails the latest time of sending by late, has passed its own; a
    repeat that comes after that is graded again, and one that is older than the watermark is dropped. Of many paths,
    start the query inside state_in_rocksdb: else all that are remembered lie in the executors' heap.
    """
    told = chosen_late(unwrap(messages, PATH), F.col("data.reasoning").isNotNull())
    rows = told.select("data.*", F.coalesce("sent_at", F.timestamp_seconds(F.lit(0))).alias("sent_at"))
    first = rows.withColumn("path_hash", path_hash("problem_id", "reasoning")).withWatermark("sent_at", late).dropDuplicatesWithinWatermark(["path_hash"])
    return verify_batch(first).select("problem_id", "sample_idx", "path_hash", "is_correct", "verification_confidence")


def stream_to_training(messages: DataFrame) -> DataFrame:
    """Verified correct paths as training messages."""
    data = lambda _: F.struct("problem_id", "sample_idx", "reasoning")
    return processor_hook("problem_id string, sample_idx long, reasoning string, is_correct boolean", lambda rows: rows.where("is_correct"), data, "training")(messages)


def dead_letters(messages: DataFrame) -> DataFrame:
    """Messages that are no JSON."""
    return unwrap(messages, "x string").where("bad").select(*messages.columns)


def stream_counts(messages: DataFrame) -> DataFrame:
    """Running totals by message type: processed and failed."""
    rows = unwrap(messages, "x string")
    return rows.groupBy(F.coalesce("type", F.lit("none")).alias("type")).agg(F.count_if(~F.col("bad")).alias("processed"), F.count_if("bad").alias("errors"))


def process_each(process: Callable[[DataFrame], DataFrame], path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: processes a micro-batch and writes it under its id, so a replay replaces it."""

    def write(batch: DataFrame, batch_id: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def bridge(messages: DataFrame, process: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Topic to topic: each processed row wrapped as {processed, data}. All rows count, partial batches too."""
    out = process(messages)
    return out.select("key", F.to_json(F.struct(F.lit(True).alias("processed"), F.struct(*[c for c in out.columns if c != "key"]).alias("data"))).alias("value"))


class _Batcher(StatefulProcessor):
    """A key's items in a list that grows by what comes; it is only read when a batch is full or the key is flushed."""

    def __init__(self, value: str, size: int, idle_ms: int | None):
        self.value, self.size, self.idle_ms = value, size, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", StructType([StructField("item", StringType())]))
        self.sums = handle.getValueState("sums", StructType([StructField("batch_no", LongType()), StructField("n", LongType())]))

    def _emitted(self, key: str, items: list[str], number: int, flushed: bool) -> tuple[list[tuple], list[str], int]:
        out = []
        while len(items) >= self.size or (flushed and items):
            out.append((key, number, items[: self.size]))
            number, items = number + 1, items[self.size :]
        return out, items, number

    def _timer(self, timers) -> None:
        if self.idle_ms:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        number, n = self.sums.get() if self.sums.exists() else (0, 0)
        found = [x for part in rows for x in part[self.value].tolist()]
        flushed = any(x is None for x in found)
        new = [x for x in found if x is not None]
        out: list[tuple] = []
        if n + len(new) >= self.size or flushed:
            held = [x[0] for x in self.held.get()] if n else []
            out, left, number = self._emitted(key[0], held + new, number, flushed)
            self.held.clear()
            if left:
                self.held.put([(x,) for x in left])
            n = len(left)
        elif new:
            self.held.appendList([(x,) for x in new])
            n += len(new)
        self.sums.update((number, n))
        self._timer(timerValues)
        yield pd.DataFrame(out, columns=["key", "batch_no", "items"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        number, n = self.sums.get() if self.sums.exists() else (0, 0)
        out, _, _ = self._emitted(key[0], [x[0] for x in self.held.get()] if n else [], number, True)
        self.held.clear()
        self.sums.clear()
        yield pd.DataFrame(out, columns=["key", "batch_no", "items"])

    def close(self) -> None:
        pass


@contextmanager
def state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB, which list state needs, and much state, as it lies on disk."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stream_batcher(rows: DataFrame, key: str, value: str, size: int, idle_ms: int | None = 1000) -> DataFrame:
    """key, batch_no, items: full batches as they fill, and a shorter one of what is left when a key is flushed.

    A row with a null value flushes its key, as the end of a source does; so does a key that is idle for idle_ms, whose
    batches are numbered from 0 again. State holds less than one batch for each key, and a trigger only writes what is
    new. rows: a stream; start the query inside state_in_rocksdb.
    """
    out = "key string, batch_no long, items array<string>"
    told = rows.select(F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias(value))
    return told.groupBy("key").transformWithStateInPandas(_Batcher(value, size, idle_ms), out, "Append", "ProcessingTime" if idle_ms else "None")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what its source holds now and writes Parquet."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
