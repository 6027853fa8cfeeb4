"""Streaming queries: each runs a stream over files with the columns of a message source, and reads what it wrote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rollforge.functions import hooks
from rollforge.functions.text import eval_step_count
from rollforge.operators import encode
from rollforge.operators.grading import verify_batch
from rollforge.plans.derived import CHATS, ROLLOUTS, chats, read, rollouts
from rollforge.plans.grading import GRADED, graded
from rollforge.plans.registry import query
from rollforge.sources.scratch import new_path
from rollforge.streaming import envelopes, pipelines

ROLLOUT = "problem_id string, sample_idx long, reasoning string, expected string"
BROKEN = "problem_idx % 97 = 0"


def _wrapped(rows: DataFrame, partition: Column | None = None) -> DataFrame:
    return envelopes.wrap(rows, F.lit("raw_reasoning"), F.struct("problem_id", "sample_idx", "reasoning", "expected"), "problem_id", F.col("problem_idx") + 1700000000.5, partition)


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollouts as raw messages; those of every 97th problem are no JSON."""
    broken = F.substring("key", 2, 20).cast("long") % 97 == 0
    return _wrapped(rollouts(spark, sf_dir)).withColumn("value", F.when(broken, F.substring("value", 2, 40)).otherwise(F.col("value")))


def _opened(messages: DataFrame, data: str) -> DataFrame:
    """key, topic, type and the data's fields of messages."""
    return messages.withColumn("e", F.from_json("value", f"type string, data struct<{data}>, timestamp double")).select("key", "topic", "e.type", "e.data.*")


def _files(spark: SparkSession, sf_dir: str, table: str) -> int:
    """Into how many files the rows that come from a table go: more for a larger table, so that a file's size is bounded."""
    return 4 * read(spark, sf_dir, table).rdd.getNumPartitions()


def _read_in_turns(spark: SparkSession, path: str, schema: StructType, turns: int = 2) -> DataFrame:
    """A folder's files as a stream that takes them in a few turns, however many there are; each turn reads them side by side."""
    n = len(spark.read.schema(schema).parquet(path).inputFiles())
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max(1, -(-n // turns))).parquet(path)


def _source(spark: SparkSession, rows: DataFrame, sf_dir: str, table: str = "lineitem") -> DataFrame:
    """rows as files, read as a stream in a few turns."""
    path = new_path(spark, "topic")
    rows.repartition(_files(spark, sf_dir, table)).write.parquet(path)
    return _read_in_turns(spark, path, rows.schema)


def _run(spark: SparkSession, stream: DataFrame) -> DataFrame:
    path = new_path(spark, "out")
    pipelines.run_available(stream, path, new_path(spark, "offsets"))
    return spark.read.schema(stream.schema).parquet(path)


@query(f"WITH {ROLLOUTS} SELECT problem_id AS key, problem_id, sample_idx, reasoning, expected, 'raw_reasoning' AS type, 'raw_reasoning_data' AS topic FROM rollouts")
def wrap_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _opened(_wrapped(rollouts(spark, sf_dir)), "problem_id:string,sample_idx:long,reasoning:string,expected:string")


@query(f"WITH {ROLLOUTS} SELECT problem_id, sample_idx, reasoning FROM rollouts")
def unwrap_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the messages have an envelope, half are bare."""
    rows = rollouts(spark, sf_dir)
    data = F.struct("problem_id", "sample_idx", "reasoning")
    value = F.when(F.col("sample_idx") % 2 == 0, F.to_json(F.struct(F.lit("x").alias("type"), data.alias("data"), F.lit(1.5).alias("timestamp")))).otherwise(F.to_json(data))
    return envelopes.unwrap(rows.select(value.alias("value")), "problem_id string, sample_idx long, reasoning string").select("data.*")


@query(f"WITH {ROLLOUTS} SELECT problem_id AS key, 'raw_reasoning_data' AS topic, (problem_idx % 4)::INTEGER AS partition, sample_idx AS offset, CASE WHEN NOT {BROKEN} THEN 'raw_reasoning' END AS type, CASE WHEN NOT {BROKEN} THEN sample_idx END AS sample_idx, {BROKEN} AS bad FROM rollouts")
def kafka_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reader's decoding of a topic's records, binary as the source gives them; broken ones are marked."""
    number = F.substring("key", 2, 20).cast("long")
    sample = F.regexp_extract("value", r'"sample_idx":(\d+)', 1)
    held = _wrapped(rollouts(spark, sf_dir)).withColumns({"partition": (number % 4).cast("int"), "offset": sample.cast("long")})
    held = held.withColumn("value", F.when(number % 97 == 0, F.substring("value", 2, 40)).otherwise(F.col("value")))
    records = held.select(F.col("key").cast("binary"), F.col("value").cast("binary"), "topic", "partition", "offset")
    return _run(spark, envelopes.decode(_source(spark, records, sf_dir), ROLLOUT)).select("key", "topic", "partition", "offset", "type", "data.sample_idx", "bad")


@query(f"WITH {ROLLOUTS} SELECT problem_id AS key, 'raw_reasoning_data' AS topic, (problem_idx % 3)::INTEGER AS partition, 'raw_reasoning' AS type, sample_idx, reasoning FROM rollouts")
def kafka_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stream hands to the sink, with an explicit partition: written by a stream of the same columns."""
    rows = rollouts(spark, sf_dir).select("problem_id", "problem_idx", "sample_idx", "reasoning", "expected")
    sent = _run(spark, _wrapped(_source(spark, rows, sf_dir), F.col("problem_idx") % 3))
    return sent.withColumn("e", F.from_json("value", "type string, data struct<sample_idx:long,reasoning:string>")).select("key", "topic", "partition", "e.type", "e.data.sample_idx", "e.data.reasoning")


@query(f"WITH {GRADED} SELECT problem_id AS key, 'verified_paths' AS topic, 'verified_path' AS type, problem_id, sample_idx, reasoning, is_correct, CASE WHEN status = 'incorrect' THEN 0.0 ELSE 1.0 END::DOUBLE AS verification_confidence FROM graded WHERE NOT {BROKEN}")
def stream_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _run(spark, pipelines.stream_verify(_source(spark, _messages(spark, sf_dir), sf_dir)))
    return _opened(out, "problem_id:string,sample_idx:long,reasoning:string,is_correct:boolean,verification_confidence:double")


@query(f"WITH {GRADED} SELECT DISTINCT problem_id, substr(md5(problem_id || ':' || reasoning), 1, 16) AS path_hash, is_correct, CASE WHEN status = 'incorrect' THEN 0.0 ELSE 1.0 END::DOUBLE AS verification_confidence FROM graded WHERE NOT {BROKEN}")
def stream_verify_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message is sent twice, in files that come at different times; each path is graded once."""
    path, rows, files = new_path(spark, "topic"), _messages(spark, sf_dir), _files(spark, sf_dir, "lineitem")
    rows.repartition(files).write.parquet(path)
    # the files that are listed here are those of the first time
    spark.read.schema(rows.schema).parquet(path).repartition(files).write.mode("append").parquet(path)
    stream = _read_in_turns(spark, path, rows.schema)
    with pipelines.state_in_rocksdb(spark):
        out = _run(spark, pipelines.verify_once(stream, "3650 days"))
    return out.select("problem_id", "path_hash", "is_correct", "verification_confidence")


@query(f"WITH {GRADED} SELECT problem_id AS key, 'training_data' AS topic, 'training_sample' AS type, problem_id, sample_idx, reasoning FROM graded WHERE is_correct AND NOT {BROKEN}")
def stream_to_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    verified = pipelines.stream_verify(_messages(spark, sf_dir))
    return _opened(_run(spark, pipelines.stream_to_training(_source(spark, verified, sf_dir))), "problem_id:string,sample_idx:long,reasoning:string")


@query("SELECT topic, sum(n)::BIGINT AS n FROM (SELECT 'raw_reasoning_data' AS topic, count(*) AS n FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT 'verified_paths', count(*) FROM orders WHERE o_orderkey % 3 = 1 UNION ALL SELECT 'training_data', count(*) FROM orders WHERE o_orderkey % 3 = 2) GROUP BY 1")
def stage_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, kind = read(spark, sf_dir, "orders"), F.col("o_orderkey") % 3
    topic = F.when(kind == 0, envelopes.stage_route("raw")).when(kind == 1, envelopes.stage_route("verified")).otherwise(envelopes.stage_route("training"))
    return o.groupBy(topic.alias("topic")).agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def stream_micro_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro-batches written under their ids by foreachBatch; all rows arrive once."""
    events = read(spark, sf_dir, "events").select("event_id", "event_type", "value")
    path = new_path(spark, "batches")
    writer = pipelines.process_each(lambda batch: batch.withColumn("error", F.when(F.col("value").isNull(), "no value")), path)
    _source(spark, events, sf_dir, "events").writeStream.foreachBatch(writer).option("checkpointLocation", new_path(spark, "offsets")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("SELECT event_type AS key, count(*) AS n, round(sum(2 * value), 2) AS total, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1")
def stream_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select(F.col("event_type").alias("key"), "event_id", "value")
    out = _run(spark, pipelines.bridge(_source(spark, events, sf_dir, "events"), lambda rows: rows.withColumn("value", F.col("value") * 2)))
    back = out.withColumn("r", F.from_json("value", "processed boolean, data struct<event_id:long,value:double>")).where("r.processed")
    return back.groupBy("key").agg(F.count("r.data.event_id").alias("n"), F.round(F.sum("r.data.value"), 2).alias("total"), F.sum("r.data.event_id").alias("ids"))


@query("SELECT event_type AS key, count(*) AS items, ceil(count(*) / 50.0)::BIGINT AS least_batches, count(*) // 50 AS full_batches, sum(event_id)::BIGINT AS ids, ceil(count(*) / 50.0)::BIGINT - 1 AS last_no FROM events GROUP BY 1")
def stream_batcher(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 50; the end of the source, a row without an item for each key, flushes what a key still holds."""
    events = read(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("event_id").cast("string").alias("item"))
    path = new_path(spark, "topic")
    events.repartition(_files(spark, sf_dir, "events")).write.parquet(path)
    events.select("key", F.lit(None).cast("string").alias("item")).distinct().coalesce(1).write.mode("append").parquet(path)
    stream = _read_in_turns(spark, path, events.schema)
    with pipelines.state_in_rocksdb(spark):
        out = _run(spark, pipelines.stream_batcher(stream, "key", "item", 50, idle_ms=None))
    ids = F.aggregate("items", F.lit(0).cast("long"), lambda total, item: total + item.cast("long"))
    return out.groupBy("key").agg(F.sum(F.size("items")).alias("items"), F.count("*").alias("least_batches"), F.count_if(F.size("items") == 50).alias("full_batches"), F.sum(ids).alias("ids"), F.max("batch_no").alias("last_no"))


@query("SELECT CASE WHEN value < 5 THEN 'none' ELSE event_type END AS type, count_if(value >= 5) AS processed, count_if(value < 5) AS errors FROM events GROUP BY 1")
def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals in complete mode; the last ones are read from the sink's files by foreachBatch."""
    events = read(spark, sf_dir, "events")
    good = F.to_json(F.struct(F.col("event_type").alias("type"), F.col("event_id").alias("data")))
    bad = F.concat(F.lit('{"type":"'), "event_type", F.lit('"'))
    counted = pipelines.stream_counts(_source(spark, events.select(F.when(F.col("value") < 5, bad).otherwise(good).alias("value")), sf_dir, "events"))
    path = new_path(spark, "counts")
    last = lambda batch, _: batch.write.mode("overwrite").parquet(path)
    counted.writeStream.outputMode("complete").foreachBatch(last).option("checkpointLocation", new_path(spark, "offsets")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path)


@query("SELECT event_id FROM events ORDER BY event_id LIMIT 300")
def limit_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator is the limit: the first messages by their offset."""
    return read(spark, sf_dir, "events").select("event_id").orderBy("event_id").limit(300)


def _upper():
    return lambda prompts: [p.upper() for p in prompts]


@query("SELECT o_orderkey, unnest(range(0, 2)) AS sample_idx, 'ORDER ' || o_orderkey AS reasoning FROM orders")
def generator_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("prompt"))
    return hooks.generator_hook(encode.fan_out_paths(o, 2), _upper).select("o_orderkey", "sample_idx", "reasoning")


def _lengths():
    return lambda prompts, responses: [float(len(r) - len(p)) for p, r in zip(prompts, responses, strict=True)]


@query(f"WITH {CHATS} SELECT conv_id, turn, (length(response) - length(prompt))::DOUBLE AS score FROM chats")
def reward_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = hooks.reward_hook(_lengths)
    return chats(spark, sf_dir).select("conv_id", "turn", score("prompt", "response").alias("score"))


@query(f"WITH {ROLLOUTS} SELECT problem_id, sample_idx, contains(reasoning, expected) AS is_correct, NULL::VARCHAR AS error FROM rollouts")
def verifier_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hooks.verifier_hook(rollouts(spark, sf_dir), F.col("reasoning").contains(F.col("expected"))).select("problem_id", "sample_idx", "is_correct", "error")


@query(f"WITH {CHATS} SELECT conv_id, turn, greatest(len(regexp_extract_all(response, '(?im)step\\s*\\d+')) + len(regexp_extract_all(response, '(?im)^\\d+\\.')) + len(regexp_extract_all(response, '(?im)first|second|third|then|next|finally')), len(regexp_extract_all(response, chr(10))) // 2)::DOUBLE AS score FROM chats")
def scorer_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hooks.scorer_hook(chats(spark, sf_dir), eval_step_count("response")).select("conv_id", "turn", "score")


@query(f"WITH {GRADED} SELECT problem_id AS key, 'verified_paths' AS topic, 'verified_path' AS type, problem_id, sample_idx FROM graded WHERE is_correct AND NOT {BROKEN}")
def processor_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's step between two topics: it grades and leaves out what is not correct."""
    keep = hooks.processor_hook(ROLLOUT, lambda rows: envelopes.chosen_late(verify_batch(rows), F.col("is_correct")), lambda _: F.struct("problem_id", "sample_idx"), "verified")
    return _opened(_messages(spark, sf_dir).transform(keep), "problem_id:string,sample_idx:long")


@query("SELECT o_custkey::VARCHAR AS key, count(*) AS n FROM orders GROUP BY 1")
def key_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any column can be the key of a message."""
    o = read(spark, sf_dir, "orders")
    return envelopes.wrap(o, F.lit("training_sample"), F.struct("o_orderkey"), F.col("o_custkey"), F.lit(0.0)).groupBy("key").agg(F.count("*").alias("n"))
