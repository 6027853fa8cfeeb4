"""Messages on topics: {type, data, timestamp} as JSON, keyed by problem."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Topics by message type and by stage, the stages' message types, and the producer's settings.
TOPICS = {"raw_reasoning": "raw_reasoning_data", "verified_path": "verified_paths", "training_sample": "training_data"}
STAGES = {"raw": "raw_reasoning_data", "verified": "verified_paths", "training": "training_data"}
TYPES = {"raw": "raw_reasoning", "verified": "verified_path", "training": "training_sample"}
PRODUCER = {"kafka.acks": "all", "kafka.retries": "3", "kafka.batch.size": "16384", "kafka.linger.ms": "10", "kafka.compression.type": "gzip"}
ENVELOPE = "type string, data string, timestamp string, broken string"


def stage_route(stage: str) -> str:
    """A stage's topic; unknown stages are errors."""
    if stage not in STAGES:
        raise ValueError(f"unknown stage {stage!r}; there are {sorted(STAGES)}")
    return STAGES[stage]


def chosen_late(rows: DataFrame, flag: Column) -> DataFrame:
    """The rows where flag holds, for batches and streams. flag's columns are computed once.

    A plain filter goes below the steps that make its columns and computes them again; one that also asks for a column
    that is no function of the row stays where it is.
    """
    return rows.withColumn("_at_", F.spark_partition_id()).where(flag & (F.col("_at_") >= 0)).drop("_at_")


def wrap(rows: DataFrame, kind: Column | str, data: Column, key: Column | str, at: Column, partition: Column | None = None) -> DataFrame:
    """key, value and topic of each row, and its partition where one is given; at: epoch seconds."""
    kind = F.col(kind) if isinstance(kind, str) else kind
    topic = F.create_map(*[F.lit(x) for pair in TOPICS.items() for x in pair])[kind]
    value = F.to_json(F.struct(kind.alias("type"), data.alias("data"), at.cast("double").alias("timestamp")))
    more = [] if partition is None else [partition.cast("int").alias("partition")]
    return rows.select((F.col(key) if isinstance(key, str) else key).cast("string").alias("key"), value.alias("value"), topic.alias("topic"), *more)


def unwrap(messages: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """The messages with type, data, sent_at and bad: the envelope's data, or the whole message where it has none.

    data is parsed twice at most: an envelope keeps its data as JSON text, which then meets the schema. Messages that
    are no JSON have bad = true and stay, so a query can send them aside.
    """
    text = F.col(value).cast("string")
    step = messages.withColumn("envelope_", F.from_json(text, ENVELOPE, {"columnNameOfCorruptRecord": "broken"}))
    bad = text.isNull() | F.col("envelope_.broken").isNotNull()
    step = step.withColumn("bad_", bad).withColumn("inner_", F.when(~F.col("bad_"), F.coalesce(F.col("envelope_.data"), text)))
    sent = F.timestamp_micros((F.col("envelope_.timestamp").try_cast("double") * 1e6).cast("long"))
    return step.select(*messages.columns, F.when(~F.col("bad_"), F.col("envelope_.type")).alias("type"), F.from_json("inner_", schema).alias("data"), sent.alias("sent_at"), F.col("bad_").alias("bad"))


def decode(records: DataFrame, schema: str) -> DataFrame:
    """A topic's records (key, value, topic, partition, offset as the source gives them) with type, data, sent_at and bad."""
    text = records.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "topic", "partition", "offset")
    return unwrap(text, schema)


def source_options(servers: list[str], topics: list[str], group: str | None = None, per_trigger: int | None = 500) -> dict[str, str]:
    """Options of a topic reader that begins with the earliest record."""
    found = {"kafka.bootstrap.servers": ",".join(servers), "subscribe": ",".join(topics), "startingOffsets": "earliest"}
    found |= {"maxOffsetsPerTrigger": str(per_trigger)} if per_trigger else {}
    return found | ({"kafka.group.id": group} if group else {})


def sink_options(servers: list[str], checkpoint: str) -> dict[str, str]:
    return {"kafka.bootstrap.servers": ",".join(servers), "checkpointLocation": checkpoint, **PRODUCER}


def kafka_source(spark: SparkSession, servers: list[str], topics: list[str], schema: str, group: str | None = None, per_trigger: int = 500) -> DataFrame:
    """A decoded stream of the topics; offsets live in the query's checkpoint. Needs Spark's Kafka package."""
    return decode(spark.readStream.format("kafka").options(**source_options(servers, topics, group, per_trigger)).load(), schema)


def kafka_batch(spark: SparkSession, servers: list[str], topics: list[str], schema: str, most: int | None = None) -> DataFrame:
    """What the topics hold now, or the first messages of it."""
    rows = spark.read.format("kafka").options(**source_options(servers, topics, None, None)).load()
    return decode(rows if most is None else rows.limit(most), schema)


def kafka_sink(rows: DataFrame, servers: list[str], checkpoint: str):
    """Starts writing key, value and topic columns, to a row's partition where there is such a column."""
    return rows.writeStream.format("kafka").options(**sink_options(servers, checkpoint)).start()
