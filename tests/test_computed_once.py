"""Costly columns are computed once: what plans show, beside the same results."""

import re

from pyspark.sql import functions as F

from rollforge.functions import grade, hooks
from rollforge.functions.text import path_hash
from rollforge.operators import encode, pairs
from rollforge.operators.grading import verify_batch
from rollforge.plans import grading, sources, streams, training
from rollforge.sources.scratch import new_path
from rollforge.streaming import envelopes, pipelines

SMALL = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_verdict_is_not_judged_again_by_a_filter(spark):
    rows = [("a", 0, "#### 4", "4"), ("a", 1, "#### 5", "4"), ("b", 0, None, "4")]
    sent = spark.createDataFrame(rows, "problem_id string, sample_idx long, reasoning string, expected string")
    messages = envelopes.wrap(sent, F.lit("raw_reasoning"), F.struct(*sent.columns), "problem_id", F.lit(1.5)).select("value")
    messages = messages.unionByName(spark.createDataFrame([("no json",), (None,)], "value string"))
    step = hooks.processor_hook("problem_id string, sample_idx long, reasoning string, expected string", lambda df: envelopes.chosen_late(verify_batch(df), F.col("is_correct")), lambda _: F.struct("problem_id", "sample_idx"), "verified")
    found = messages.transform(step)
    assert [r.value for r in found.collect()] == ['{"type":"verified_path","data":{"problem_id":"a","sample_idx":0},"timestamp":1.5}']
    filters = [line for line in plan_of(found).splitlines() if re.match(r"[\s:+-]*Filter", line)]
    assert filters and not any("from_json" in line or "regexp" in line.lower() or "rlike" in line.lower() for line in filters)


def test_a_message_that_may_come_again_is_opened_once(spark):
    rows = [("a", 0, "#### 4", "4"), ("a", 1, "#### 4", "4"), ("a", 2, "#### 5", "4"), ("b", 0, None, "4")]
    sent = spark.createDataFrame(rows, "problem_id string, sample_idx long, reasoning string, expected string")
    messages = envelopes.wrap(sent, F.lit("raw_reasoning"), F.struct(*sent.columns), "problem_id", F.lit(1.5)).select("value")
    messages = messages.unionByName(spark.createDataFrame([("no json",), (None,)], "value string"))
    path = new_path(spark, "topic")
    for _ in range(2):
        messages.coalesce(1).write.mode("append").parquet(path)
    stream = pipelines.verify_once(spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", 1).parquet(path), "3650 days")
    with pipelines.state_in_rocksdb(spark):
        ran = stream.writeStream.format("memory").queryName("opened_once").option("checkpointLocation", new_path(spark, "offsets")).trigger(availableNow=True).start()
    ran.awaitTermination()
    assert sorted((r.problem_id, r.is_correct) for r in spark.table("opened_once").collect()) == [("a", False), ("a", True)]
    filters = [line for line in ran._jsq.explainInternal(False).splitlines() if re.match(r"[\s:+*()\d-]*Filter", line)]
    assert filters and not any("from_json" in line for line in filters)


def test_paths_that_are_remembered_lie_on_disk(spark, monkeypatch):
    held, name = [], "spark.sql.streaming.stateStore.providerClass"
    plain = pipelines.run_available
    monkeypatch.setattr(pipelines, "run_available", lambda *given: held.append(spark.conf.get(name)) or plain(*given))
    before = spark.conf.get(name)
    got = {tuple(r) for r in streams.stream_verify_once(spark, SMALL).collect()}
    rows = grading.graded(spark, SMALL).where(~F.expr(streams.BROKEN)).select("problem_id", path_hash("problem_id", "reasoning"), "is_correct", "verification_confidence")
    assert got == {tuple(r) for r in rows.distinct().collect()}
    assert held[0].endswith("RocksDBStateStoreProvider") and spark.conf.get(name) == before


def test_rewards_and_ranks_are_written_before_they_meet(spark, monkeypatch):
    rows = [("p", i, i % 2 == 0) for i in range(6)]
    df = spark.createDataFrame(rows, "problem_id string, sample_idx long, is_correct boolean")
    made, plain = [], pairs.written
    monkeypatch.setattr(pairs, "written", lambda found, name: made.append(name) or plain(found, name))
    rewards = df.select("problem_id", "sample_idx", (F.col("sample_idx") / 10).alias("reward")).where("sample_idx <> 3")
    got = {tuple(r) for r in pairs.rejudge_rewards(pairs.capped_pairs(df), rewards).select("c_idx", "r_idx", "chosen_reward", "rejected_reward").collect()}
    assert got == {(0, 1, 0.0, 0.1), (0, 3, 0.0, None), (2, 1, 0.2, 0.1), (2, 3, 0.2, None)}
    assert "few" in made and "rewards" in made


def test_a_report_grades_once(spark, monkeypatch):
    made, plain = [], sources.written if hasattr(sources, "written") else None
    monkeypatch.setattr(sources, "written", lambda found, name: made.append(name) or plain(found, name), raising=False)
    rows = sources.write_eval_report(spark, SMALL).collect()
    assert made == ["graded"] and all(r.n == r.details for r in rows)


def test_padding_is_text_before_it_is_joined(spark):
    found = training.encode_reward_pair(spark, SMALL)
    assert not re.search(r"transform\((slice\()?concat", plan_of(found))
    ids = spark.createDataFrame([(["5", "6"],), ([],), (None,), (["1"] * 5,)], "ids array<string>")
    assert [r[0] for r in ids.select(encode.pad(F.col("ids"), 3, "0")).collect()] == [["5", "6", "0"], ["0"] * 3, None, ["1"] * 3]


def test_what_fills_a_text_of_ids_is_no_element(spark):
    assert "array_repeat" not in plan_of(training.encode_reward_pair(spark, SMALL))
    ids = spark.createDataFrame([(["5", "6"],), ([],), (None,), (["1"] * 5,), (["7"] * 4,), ([None, "8"],), (["", "9"],)], "ids array<string>")
    both = [tuple(r) for r in ids.select(encode.padded_text(F.col("ids"), 4), F.array_join(encode.pad(F.col("ids"), 4, "0"), ",")).collect()]
    assert both == [(x, x) for x in ["5,6,0,0", "0,0,0,0", None, "1,1,1,1", "7,7,7,7", "8,0,0", ",9,0,0"]]


def test_texts_of_digits_meet_no_pattern(spark):
    texts = ["42", "007", "4 2", "4\n", "", None, "1,000", "#### 3", "-5", "3/4", "$12"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    got = [tuple(r) for r in df.select(grade.extract_final_answer("t"), grade.normalize_answer("t"), grade.numeric_of(F.col("t"))).collect()]
    assert got == [(None, "42", 42.0), (None, "007", 7.0), (None, "4 2", None), (None, "4", 4.0), (None, "", None), (None, "", None), (None, "1000", None), ("3", "#### 3", None), (None, "-5", -5.0), (None, "3/4", 0.75), (None, "12", None)]
    assert r"\A[0-9]+\z" in plan_of(df.select(grade.normalize_answer("t")))
