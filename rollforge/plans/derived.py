"""Rollout-shaped tables that queries derive from the given ones, each with the same table in SQL.

rollouts      lineitem as sampled solutions of an order: reasoning in seven styles, expected = the order's largest quantity
answers       documents as responses about a problem (their source), with labels as verdicts
chats         user turns with the next assistant turn
steps         events as a log of training steps
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollforge.operators.ordinals import numbered


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """A table that comes in fewer splits than there are cores, dealt out over all of them; larger ones are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def text_of(parts: list) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """problem_id, problem_idx, sample_idx, problem, reasoning, expected, confidence, price, quantity."""
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount")
    order = Window.partitionBy("l_orderkey")
    place = F.row_number().over(order.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")) - 1
    q, p = F.col("l_quantity").cast("long"), F.col("l_partkey").cast("long")
    style = F.col("sample_idx") % 7
    said = (
        F.when(style == 0, text_of(["Step 1: we take ", p, " parts.\nStep 2: so we have ", q, " units.\n#### ", q]))
        .when(style == 1, text_of(["First we count the parts. The answer is ", q, "."]))
        .when(style == 2, text_of(["We get \\boxed{", q, "}"]))
        .when(style == 3, text_of(["Then look again. Therefore, ", q, " dollars."]))
        .when(style == 4, text_of([q, " + 0 = ", q]))
        .when(style == 5, text_of(["1) Half is not it.\n2) #### ", q, ",000 is wrong\n#### $", q, ".00"]))
        .otherwise(text_of(["I do not know, maybe ", q, " or not"]))
    )
    out = items.withColumn("sample_idx", place).withColumn("best", F.max("l_quantity").over(order))
    return out.select(
        F.concat(F.lit("p"), F.col("l_orderkey").cast("string")).alias("problem_id"), F.col("l_orderkey").alias("problem_idx"), "sample_idx", text_of(["What is the largest quantity of order ", F.col("l_orderkey"), "?"]).alias("problem"), said.alias("reasoning"),
        F.col("best").cast("long").cast("string").alias("expected"), F.round("l_discount", 2).alias("confidence"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"),
    )


ROLLOUTS = """r0 AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS i, max(l_quantity) OVER (PARTITION BY l_orderkey) AS best, l_quantity::BIGINT::VARCHAR AS q FROM lineitem),
rollouts AS (SELECT 'p' || l_orderkey AS problem_id, l_orderkey AS problem_idx, i AS sample_idx, 'What is the largest quantity of order ' || l_orderkey || '?' AS problem,
  CASE i % 7 WHEN 0 THEN 'Step 1: we take ' || l_partkey || ' parts.' || chr(10) || 'Step 2: so we have ' || q || ' units.' || chr(10) || '#### ' || q
   WHEN 1 THEN 'First we count the parts. The answer is ' || q || '.' WHEN 2 THEN 'We get \\boxed{' || q || '}' WHEN 3 THEN 'Then look again. Therefore, ' || q || ' dollars.'
   WHEN 4 THEN q || ' + 0 = ' || q WHEN 5 THEN '1) Half is not it.' || chr(10) || '2) #### ' || q || ',000 is wrong' || chr(10) || '#### $' || q || '.00'
   ELSE 'I do not know, maybe ' || q || ' or not' END AS reasoning,
  best::BIGINT::VARCHAR AS expected, round(l_discount, 2) AS confidence, l_extendedprice AS price, l_quantity AS quantity FROM r0)"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """problem_id (source), sample_idx (doc_id), problem, reasoning, is_correct, confidence."""
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = spread(read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"), "doc_id")
    right = F.coalesce(F.col("quality") == 1, F.lit(False))
    return docs.join(labels, "doc_id", "left").select(
        F.col("source").alias("problem_id"), F.col("doc_id").alias("sample_idx"), F.concat(F.lit("Write about "), "lang").alias("problem"), F.col("text").alias("reasoning"),
        right.alias("is_correct"), (F.col("doc_id") % 7 / 7.0).alias("confidence"), "lang",
    )


ANSWERS = """answers AS (SELECT source AS problem_id, d.doc_id AS sample_idx, 'Write about ' || lang AS problem, text AS reasoning, coalesce(quality = 1, false) AS is_correct, (d.doc_id % 7) / 7.0::DOUBLE AS confidence, lang
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, prompt, response: each user turn that an assistant turn follows."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = read(spark, sf_dir, "conversations").withColumn("next_role", F.lead("role").over(order)).withColumn("response", F.lead("text").over(order))
    return turns.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("prompt"), "response")


CHATS = """c0 AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS response FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
chats AS (SELECT conv_id, turn, text AS prompt, response FROM c0 WHERE role = 'user' AND next_role = 'assistant')"""


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """worker, step, loss, margin, kl, seconds: an event log read as one training log per event type."""
    events = numbered(read(spark, sf_dir, "events").select("event_type", "ts", "event_id", "value", "user_id"), ["event_type"], ["ts", "event_id"])
    return events.select(
        F.col("event_type").alias("worker"), (F.col("place") + 1).alias("step"), F.col("value").alias("loss"), (F.col("value") - 50).alias("margin"),
        (F.col("user_id") % 10 / 10.0).alias("kl"), (F.col("value") / 1000).alias("seconds"),
    )


STEPS = """steps AS (SELECT event_type AS worker, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS step, value AS loss, value - 50 AS margin, (user_id % 10) / 10.0::DOUBLE AS kl, value / 1000 AS seconds FROM events)"""
