import json
import math
import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from rollforge import jobs
from rollforge.functions import text as tx
from rollforge.operators import clean, encode, evals, pairs, search, training
from rollforge.operators.ordinals import numbered
from rollforge.plans import registry
from rollforge.sources import readers


def jaccard(a, b):
    a, b = set(a.lower().split()), set(b.lower().split())
    return len(a & b) / len(a | b) if a and b else 0.0


def greedy_model(rows, threshold=0.85):
    """rows: (problem, idx, text, confidence). Kept (problem, idx)."""
    out = set()
    for problem in {r[0] for r in rows}:
        kept = []
        for row in sorted(r for r in rows if r[0] == problem):
            same = next((k for k in kept if jaccard(k[2], row[2]) > threshold), None)
            if same is None:
                kept.append(row)
            elif row[3] > same[3]:
                kept.remove(same)
                kept.append(row)
        out |= {(r[0], r[1]) for r in kept}
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_dedup_greedy_like_the_plain_pass(spark, seed):
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(40)]
    rows = []
    for p in range(6):
        base = [rng.choice(words) for _ in range(30)]
        for i in range(25):
            text = base[:] if rng.random() < 0.8 else [rng.choice(words) for _ in range(rng.choice([0, 1, 30]))]
            for _ in range(rng.choice([0, 0, 1, 2])):
                if text:
                    text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((f"p{p}", i, " ".join(text), rng.choice([0.1, 0.5, 0.9])))
    df = spark.createDataFrame(rows, "problem_id string, sample_idx long, reasoning string, confidence double")
    got = {(r.problem_id, r.sample_idx) for r in clean.dedup_greedy(df).collect()}
    assert got == greedy_model(rows)


def test_dedup_keeps_rows_without_keys_and_repeated_keys(spark):
    schema = "problem_id string, sample_idx long, reasoning string, confidence double, row_ string, tokens string"
    texts = ["a b c d e f g", "a b c d e f g", "k l m n", "o p q r", "o p q r"]
    rows = [(None, None, texts[0], 0.5), (None, None, texts[1], 0.9), ("", 3, texts[2], None), ("p", 3, texts[3], 0.1), ("p", 3, texts[4], 0.1)]
    df = spark.createDataFrame([(*r, "own", "own") for r in rows], schema).coalesce(1)
    got = sorted(((r.problem_id or "", r.reasoning, r.confidence) for r in clean.dedup_greedy(df).collect()), key=str)
    assert got == [("", "a b c d e f g", 0.9), ("", "k l m n", None), ("p", "o p q r", 0.1)]
    assert clean.dedup_greedy(df).columns == df.columns


def cleaned_model(lines):
    """The plain pass over samples that all pass the filters, in reading order."""
    kept = []
    for i, line in enumerate(lines):
        key = line.get("problem_id", line.get("id", ""))
        same = next((k for k in kept if k[0] == key and jaccard(k[2], line["reasoning"]) > 0.85), None)
        if same is not None and line.get("verification_confidence", 0) > same[3]:
            kept.remove(same)
            same = None
        if same is None:
            kept.append((key, i, line["reasoning"], line.get("verification_confidence", 0)))
    return sorted((k[0], k[2]) for k in kept)


def long_text(seed, changed=0):
    rng = random.Random(seed)
    words = [f"w{rng.randrange(10_000)}" for _ in range(80)]
    for i in range(changed):
        words[i] = f"changed{seed}x{i}"
    return "Step 1: look. Step 2: add. " + " ".join(words) + " The answer is 4"


def test_preprocess_job_keeps_rows_without_sample_idx(spark, tmp_path):
    lines = [{"problem_id": f"p{i % 3}", "problem": "What?", "reasoning": long_text(i // 4, i % 4 and 2), "is_correct": i % 2 == 0, "verification_confidence": (i * 7 % 5) / 5} for i in range(24)]
    lines += [{"id": "only-id", "response": long_text(50)}, {"reasoning": long_text(51)}, {"reasoning": long_text(51)}]
    (tmp_path / "in.jsonl").write_text("".join(json.dumps(x) + "\n" for x in lines) + "{no json\n")
    jobs.main(["preprocess", "--input", f"file://{tmp_path}/in.jsonl", "--output", f"file://{tmp_path}/out", "--pairs-output", f"file://{tmp_path}/pairs"])
    got = sorted((r.problem_id, r.reasoning) for r in spark.read.json(f"file://{tmp_path}/out").collect())
    lines[24]["reasoning"] = lines[24]["response"]
    assert got == cleaned_model(lines)
    stats = {r.name: r.n for r in spark.read.json(f"file://{tmp_path}/out-stats").collect()}
    assert stats["input_samples"] == 27 and stats["output_samples"] == len(got) == 27 - stats["dedup_removed"]
    assert stats["pairs_created"] > 0 and {r.prompt for r in spark.read.json(f"file://{tmp_path}/pairs").collect()} == {"What?"}


def test_pipeline_job_from_problems_to_training_files(spark, tmp_path):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import tests
    (tmp_path / "problems.jsonl").write_text("".join(json.dumps({"id": f"q{i}", "problem": f"What is {i}?", "answer": str(i % 2)}) + "\n" for i in range(6)))
    jobs.main(["pipeline", "--problems", f"file://{tmp_path}/problems.jsonl", "--generator", f"{__name__}:made", "--num-paths", "4", "--output", f"file://{tmp_path}/run"])
    read = lambda part: spark.read.json(f"file://{tmp_path}/run/{part}").collect()
    assert len(read("all")) == 24 and len(read("sft")) == 12
    assert len(read("dpo")) > 0 and all(r.prompt.startswith("What is") for r in read("dpo"))
    assert {r.method: r.solved for r in read("evaluation")}["pass@4"] == 6
    jobs.main(["pipeline", "--samples", f"file://{tmp_path}/run/all", "--output", f"file://{tmp_path}/again", "--skip-eval"])
    assert len(spark.read.json(f"file://{tmp_path}/again/sft").collect()) == 12


def made():
    """A generator whose answers are right in every other text."""
    count = iter(range(10_000))
    return lambda prompts: [long_text(1000 + hash((p, n)) % 10_000) + f"\n#### {n % 2}" for p in prompts for n in [next(count)]]


def test_grading_compiles_whole(spark, sf_dir):
    registry.load()
    before = {k: spark.conf.get(k) for k in ("spark.sql.codegen.fallback", "spark.sql.codegen.factoryMode")}
    try:
        spark.conf.set("spark.sql.codegen.fallback", "false")
        spark.conf.set("spark.sql.codegen.factoryMode", "CODEGEN_ONLY")
        for name in ("smart_pair_join", "pass_at_k", "grade_math", "grade_gsm8k", "verify_batch", "majority_vote", "verifier_guided_budget", "job_evaluate"):
            registry.QUERIES[name](spark, sf_dir).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_numbers_in_large_groups(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", None]), rng.randrange(40), i, "own") for i in range(300)]
    df = spark.createDataFrame(rows, "k string, v long, i long, part string").repartition(5)
    got = {r.i: (r.place, r.place_n) for r in numbered(df, ["k"], ["v", "i"]).collect()}
    want = {}
    for k in ("a", None):
        own = sorted((v, i) for g, v, i, _ in rows if g == k)
        want |= {i: (n, len(own)) for n, (_, i) in enumerate(own)}
    assert got == want and numbered(df, [], ["i"]).where("place <> i").count() == 0
    assert numbered(df.limit(0), ["k"], ["v"]).count() == 0


def test_positions_split_with_gaps(spark):
    df = spark.createDataFrame([(i * 10 + 5,) for i in range(20)], "n long")
    assert sorted(r.n for r in training.positional_split(df, "n").where("split = 'eval'").collect()) == [185, 195]


def test_pairs_of_a_large_problem_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(pairs, "PAIRS_PER_TASK", 7)
    rows = [("p", i, i % 3 == 0, f"text {i} " + "w " * (i % 5), (i % 4) / 4) for i in range(40)] + [("q", 0, True, "x", 0.1), ("q", 1, None, "y", 0.1)]
    df = spark.createDataFrame(rows, "problem_id string, sample_idx long, is_correct boolean, reasoning string, confidence double")
    got = sorted((r.problem_id, r.c_idx, r.r_idx) for r in pairs.rejection_pairs(df).collect())
    assert got == sorted([("p", i, j) for i in range(0, 40, 3) for j in range(40) if j % 3] + [("q", 0, 1)])


def test_dedup_of_nothing_and_of_empty_texts(spark):
    schema = "problem_id string, sample_idx long, reasoning string, confidence double"
    assert clean.dedup_greedy(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([("p", 0, "", None), ("p", 1, "", 1.0), ("p", 2, None, 1.0)], schema)
    assert clean.dedup_greedy(df).count() == 3


def test_reject_reasons(spark):
    long = "Step 1: add the numbers. Step 2: look at what they make together, all of them. The answer is 4. " + " ".join(f"w{i}" for i in range(60))
    rows = [("a", long, None), ("b", "no steps at all here", "no_steps"), ("c", "Step 1 and step 2 say nothing more", "no_answer"), ("d", "Step 1. Step 2. The answer is 4.", "too_short"), ("e", "Step 1. The final answer is certainly 4. " * 20, "repetitive"), ("f", None, "no_steps")]
    df = spark.createDataFrame([(k, t) for k, t, _ in rows], "k string, reasoning string")
    got = {r.k: r.reject_reason for r in clean.with_reasons(df.fillna("")).collect()}
    assert got == {k: w for k, _, w in rows}


def test_pairs_keep_order_and_cap(spark):
    rows = [("p", i, i % 2 == 0, f"text {i} " + "w " * i, (i % 3) / 2) for i in range(8)] + [("q", 0, True, "alone", 1.0)]
    df = spark.createDataFrame(rows, "problem_id string, sample_idx long, is_correct boolean, reasoning string, confidence double")
    assert pairs.rejection_pairs(df).count() == 16
    smart = pairs.smart_pair_join(df, most=3).orderBy("rank").collect()
    assert [r["rank"] for r in smart] == [1, 2, 3]
    assert smart[0].diversity_score >= smart[2].diversity_score
    assert pairs.both_sides(df).count() == 8
    assert pairs.capped_pairs(df).count() == 4


def test_empty_texts_differ_between_pair_rules(spark):
    df = spark.createDataFrame([("p", 0, True, "", 1.0), ("p", 1, False, "x", 1.0)], "problem_id string, sample_idx long, is_correct boolean, reasoning string, confidence double")
    assert pairs.pair_join(df).count() == 0
    assert pairs.smart_pair_join(df).count() == 1


def test_votes_and_ties(spark):
    rows = [("p", 0, "a", 1.0), ("p", 1, "b", 2.0), ("p", 2, "b", 0.1), ("p", 3, "a", 0.1), ("p", 4, None, 9.0), ("q", 0, None, 1.0)]
    df = spark.createDataFrame(rows, "problem_id string, sample_idx long, answer string, score double")
    assert sorted((r.problem_id, r.answer, r.votes, r.confidence, r.best_idx) for r in evals.majority_vote(df).collect()) == [("p", "a", 2, 0.5, 0), ("q", None, 0, None, 0)]
    assert sorted((r.problem_id, r.answer, r.best_idx) for r in evals.weighted_vote(df).collect()) == [("p", "b", 1), ("q", None, 0)]
    none = spark.createDataFrame([("p", 0, "", 1.0), ("p", 1, None, 3.0), ("p", 2, None, 3.0)], df.schema)
    assert [(r.answer, r.n_answers, r.best_idx) for r in evals.majority_vote(none).collect()] == [(None, 0, 1)]
    assert {(r.problem_id, r.best_idx) for r in evals.best_of_n(df).collect()} == {("p", 4), ("q", 0)}


def test_pass_at_k_counts_empty_problems(spark):
    problems = spark.createDataFrame([("p",), ("q",), ("r",)], "problem_id string")
    samples = spark.createDataFrame([("p", 0, False), ("p", 3, True), ("q", 0, True)], "problem_id string, sample_idx int, is_correct boolean")
    assert {(r.k, r.passed, r.n_problems) for r in evals.pass_at_k(problems, samples, [1, 4]).collect()} == {(1, 1, 3), (4, 2, 3)}
    assert {(r.problem_id, r.solved, r.used) for r in evals.verifier_guided_budget(problems, samples, 2, 6).collect()} == {("p", True, 4), ("q", True, 2), ("r", False, 6)}


def test_single_row_group_has_no_advantage(spark):
    df = spark.createDataFrame([("p", 0, True), ("q", 0, True), ("q", 1, False)], "prompt string, idx int, is_chosen boolean")
    got = {(r.prompt, r.idx): r.advantage for r in training.group_advantage(df).collect()}
    assert got[("p", 0)] is None
    assert math.isclose(got[("q", 0)], 1 / math.sqrt(2), rel_tol=1e-6)


def test_ranking_loss_does_not_overflow(spark):
    df = spark.createDataFrame([(0.0, 5000.0), (5000.0, 0.0)], "chosen_score double, rejected_score double")
    assert training.pairwise_ranking_loss(df).first().loss == 2500.0


def test_ngrams_and_repetition(spark):
    df = spark.createDataFrame([("a b c d e f",), ("a b",), ("",)], "t string")
    got = [r[0] for r in df.select(tx.ngrams(tx.words("t"), 5)).collect()]
    assert got == [["a b c d e", "b c d e f"], [], []]
    assert [r[0] for r in df.select(tx.ngrams(tx.words("t"), 5, drop_last=True)).collect()] == [["a b c d e"], [], []]


def test_encoding_shapes(spark):
    df = spark.createDataFrame([([1, 2, 3], [4, 5, 6, 7])], "p array<int>, r array<int>").select(encode.encode_pair(F.col("p"), F.col("r"), 2, 5).alias("e"), encode.pad(F.col("p"), 5).alias("pad"))
    row = df.first()
    assert row.e.input_ids == [1, 2, 4, 5, 6]
    assert row.e.labels == [-100, -100, 4, 5, 6]
    assert row.e.attention_mask == [1] * 5
    assert row.pad == [1, 2, 3, 0, 0]


def test_prefixes(spark):
    queries = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["x"]), (3, [])], "query_id int, tokens array<string>")
    stored = spark.createDataFrame([(["a"],), (["a", "b"],), (["a", "b"],), (["b"],)], "tokens array<string>")
    assert {(r.query_id, r.matched, r.hit) for r in search.longest_prefix_join(queries, stored).collect()} == {(1, 2, True), (2, 0, False), (3, 0, False)}


def test_encoding_cuts_and_pads(spark):
    rows = spark.createDataFrame([(1, "a b c d", "a a", "b"), (2, "a", None, "b"), (3, "", "x", "a")], "k int, prompt string, chosen string, rejected string")
    vocab = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "word string, id int")
    got = {r.k: (r.prompt_input_ids, r.chosen_input_ids, r.rejected_input_ids) for r in encode.tokenize_pairs(rows, ["k"], vocab, 4).collect()}
    assert got == {1: ([1, 2], [1, 1], [2]), 2: (None, None, None), 3: ([], [0], [1])}
    one = encode.tokenize_batch(rows.withColumnRenamed("prompt", "text"), ["k"], vocab, 3).orderBy("k").collect()
    assert [(r.input_ids, r.attention_mask) for r in one] == [([1, 2, 3], [1, 1, 1]), ([1], [1]), ([], [])]
    batch = encode.collate_batch(spark.createDataFrame([(0, 0, [1, 2]), (0, 1, [3])], "batch_id int, place int, input_ids array<int>"), []).first()
    assert (batch.format, batch.input_ids, batch.attention_mask) == ("standard", [[1, 2], [3]], [[], []])


def test_coalesced_fields_take_the_first_that_is_there(spark):
    df = spark.createDataFrame([(None, "r", "i")], "reasoning string, response string, id string")
    row = clean.coalesce_fields(df, {"text": ["reasoning", "response"], "problem_id": ["problem_id", "id"], "none": ["nothing"]}).first()
    assert (row.text, row.problem_id, row.none) == ("r", "i", "")


def test_a_math_subset_counts_rows_before_the_filters(spark):
    rows = spark.createDataFrame([(0, "L1"), (1, "L2"), (2, "L1"), (3, "L2"), (1500, "L2")], "idx long, level string").selectExpr("idx", "'p' AS problem", "'so \\\\boxed{7}' AS solution", "level", "'F' AS type")
    ids = lambda **options: sorted(r.problem_idx for r in readers.math(rows, level="L2", subject="F", **options).collect())
    assert (ids(), ids(subset=3), ids(subset=2, limit_after_filter=True)) == ([1, 3, 1500], [1], [1, 3])


def test_whole_math_reads_past_the_subset(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderpriority", "o_orderstatus").collect()
    least = min(r.o_orderpriority for r in orders)
    want = {r.o_orderkey for r in orders if (r.o_orderpriority, r.o_orderstatus) == (least, "F")}
    registry.load()
    got = {r.problem_idx for r in registry.QUERIES["read_math_whole"](spark, sf_dir).collect()}
    assert got == want and max(got) >= 1000


def test_rewards_come_up_from_any_depth(spark):
    nodes = spark.createDataFrame([("p", i, i - 1 if i else None, 1, 0.5) for i in range(40)], "problem_id string, node_id long, parent_id long, visits long, value double")
    got = {r.node_id: (r.visits, r.value) for r in search.reward_by_node(nodes).collect()}
    assert got == {i: (40 - i, (40 - i) / 2) for i in range(40)}
    with pytest.raises(ValueError, match="deeper"):
        search.reward_by_node(nodes, max_depth=3)


def test_subword_ids_are_the_libraries(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from rollforge.functions import hooks
    from rollforge.plans.training import subword_tokenizer

    texts = ["Hello  there, you!", None, "", "naïve <|endoftext|> 北京", "a " * 3000, "Hello  there, you!"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string").repartition(3)
    got = {r.i: r for r in encode.tokenize_subwords(rows, hooks.tokenizer_hook(subword_tokenizer()), 2048).collect()}
    assert {i: r.input_ids for i, r in got.items()} == {i: None if t is None else tokenizer.encode(t, add_special_tokens=False).ids[:2048] for i, t in enumerate(texts)}
    assert all(r.input_ids is None or len(r.attention_mask) == len(r.input_ids) for r in got.values())


def test_sketched_percentiles_are_near_and_merge(spark):
    rng = random.Random(3)
    rows = [(w, d, rng.expovariate(1) if w == "a" else 0.25) for w in ("a", "b") for d in range(5) for _ in range(2000)] + [("few", 0, 1.0)]
    log = spark.createDataFrame(rows, "worker string, day int, seconds double").repartition(4)
    got = {r.worker: r for r in evals.latency_of_sketches(evals.latency_sketches(log, ["worker", "day"]), ["worker"]).collect()}
    mine = sorted(s for w, _, s in rows if w == "a")
    for name, p in (("p50_ms", 0.5), ("p95_ms", 0.95), ("p99_ms", 0.99)):
        rank = sum(s * 1000 <= got["a"][name] + 1e-3 for s in mine) / len(mine)
        assert abs(rank - p) < 0.02
        assert got["b"][name] == 250.0
    assert got["a"].n == 10_000 and (got["few"].p95_ms, got["few"].p99_ms, got["few"].p50_ms) == (0.0, 0.0, 1000.0)
