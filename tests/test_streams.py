import pytest
from pyspark.sql import functions as F

from rollforge.plans import registry, streams
from rollforge.sources.scratch import new_path
from rollforge.streaming import envelopes, pipelines


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_stream_verify_is_the_batch_result(spark, sf_dir):
    registry.load()
    batch = pipelines.stream_verify(streams._messages(spark, sf_dir))
    opened = streams._opened(batch, "problem_id:string,sample_idx:long,reasoning:string,is_correct:boolean,verification_confidence:double")
    assert rows(streams.stream_verify(spark, sf_dir)) == rows(opened)
    assert pipelines.dead_letters(streams._messages(spark, sf_dir)).count() + batch.count() == streams._messages(spark, sf_dir).count()


def test_options_of_the_topic_reader_and_writer():
    read = envelopes.source_options(["a:1", "b:2"], ["raw_reasoning_data", "verified_paths"], "readers")
    assert read == {"kafka.bootstrap.servers": "a:1,b:2", "subscribe": "raw_reasoning_data,verified_paths", "startingOffsets": "earliest", "maxOffsetsPerTrigger": "500", "kafka.group.id": "readers"}
    assert "maxOffsetsPerTrigger" not in envelopes.source_options(["a:1"], ["t"], None, None)
    sent = envelopes.sink_options(["a:1"], "/there")
    assert (sent["kafka.acks"], sent["kafka.compression.type"], sent["checkpointLocation"]) == ("all", "gzip", "/there")


def test_an_explicit_partition_goes_with_the_message(spark):
    df = spark.createDataFrame([("p", 7)], "problem_id string, n int")
    out = envelopes.wrap(df, F.lit("raw_reasoning"), F.struct("n"), "problem_id", F.lit(0.0), F.col("n"))
    assert out.columns == ["key", "value", "topic", "partition"] and out.first().partition == 7


def test_batches_in_order_with_a_restart_in_between(spark):
    path, out, offsets = new_path(spark, "topic"), new_path(spark, "out"), new_path(spark, "offsets")
    schema, sent = "key string, item string", {"a": [], "b": []}

    def arrive(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        for key, item in rows:
            sent[key] += [item] * (item is not None)
        # a new query each time: offsets, held items and batch numbers come from the checkpoint
        with pipelines.state_in_rocksdb(spark):
            pipelines.run_available(pipelines.stream_batcher(spark.readStream.schema(schema).parquet(path), "key", "item", 4, idle_ms=None), out, offsets)
        return sorted((r.key, r.batch_no, r["items"]) for r in spark.read.schema("key string, batch_no long, items array<string>").parquet(out).collect())

    assert arrive(*[("a", f"a{i}") for i in range(3)]) == []
    assert arrive(*[("a", f"a{i}") for i in range(3, 9)], ("b", "b0")) == [("a", 0, ["a0", "a1", "a2", "a3"]), ("a", 1, ["a4", "a5", "a6", "a7"])]
    assert len(arrive(("b", "b1"), ("a", "a9"))) == 2
    last = arrive(("a", None), ("b", "b2"), ("b", "b3"), ("b", "b4"))
    assert last[2:] == [("a", 2, ["a8", "a9"]), ("b", 0, ["b0", "b1", "b2", "b3"])]
    assert [x for k, _, items in last if k == "a" for x in items] == sent["a"]
    assert arrive(("b", None))[-1] == ("b", 1, ["b4"])


def test_routes():
    assert [envelopes.stage_route(s) for s in ("raw", "verified", "training")] == ["raw_reasoning_data", "verified_paths", "training_data"]
    with pytest.raises(ValueError):
        envelopes.stage_route("nowhere")


def test_broken_messages_are_marked(spark):
    df = spark.createDataFrame([('{"type":"x","data":{"x":"1"},"timestamp":1.5}',), ('{"x":"2"}',), ("{broken",), (None,)], "value string")
    got = [(r.data.x if r.data else None, r.bad) for r in envelopes.unwrap(df, "x string").collect()]
    assert got[:3] == [("1", False), ("2", False), (None, True)]
