"""The chain's cheaper forms against the plain ones: the same verdicts and the same near-duplicates."""

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from rollforge.functions import text as tx
from rollforge.operators import clean
from rollforge.plans.cleaning import samples

ODD = [
    "", " ", "Step 1 and step  2", "STEP 3) then 4. we CAN", "first second", "Let's go; we need it", "thence", "so", "THUS x", "x = 3.5\ny", "x = 3.5 \n", "the final answer : 3", "\\boxed{1}", "####", None,
    "a\n\n\n\nb   c  d", "  $$  x  $$ <|end|> y [INST] a\nb [/INST] z", "$ $$", "<| open", "[INST] open", "assistant: AI: hi", "$$$ $$$$", "Response:   <|a|><|b|>",
    "a b c d e f g h. " * 30, "one two three four five six seven eight nine ten. " + "red blue. " * 40,
]


def _echoes(c: str) -> Column:
    """is_repetitive as it is defined, with the texts of all 5-grams."""
    found, tokens = tx.sentences(c), tx.words(c)
    grams = tx.ngrams(tokens, 5, drop_last=True)
    few = F.size(F.array_distinct(found)) / F.nullif(F.size(found), F.lit(0)) < 0.7
    echo = (F.size(tokens) >= 20) & (F.size(grams) > 0) & (F.size(F.array_distinct(grams)) / F.nullif(F.size(grams), F.lit(0)) < 0.5)
    return F.when(F.size(found) < 3, False).when(few, True).otherwise(F.coalesce(echo, F.lit(False)))


def test_a_text_is_split_into_words_once(spark, sf_dir):
    plan = clean.with_reasons(samples(spark, sf_dir))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(lower(") == 1


def test_verdicts_are_those_of_the_plain_forms(spark, sf_dir):
    odd = spark.createDataFrame([(t,) for t in ODD], "reasoning string")
    for rows in (odd, samples(spark, sf_dir).select("reasoning")):
        rows = rows.localCheckpoint()
        normal = tx.strip(F.regexp_replace(F.regexp_replace("reasoning", tx.NEWLINES, "\n\n"), tx.SPACES, " "))
        normal = F.regexp_replace(F.regexp_replace(normal, tx.AFTER_MATH, r"\$\$"), tx.BEFORE_MATH, r"\$\$")
        for pattern in (tx.SPEAKER, tx.SPECIAL, tx.INSTRUCTION):
            normal = F.regexp_replace(normal, pattern, "")
        answer = reduce(Column.__or__, [F.col("reasoning").rlike("(?dim)" + p) for p in tx.ANSWER_MARKERS])
        pairs = [(tx.normalize_reasoning("reasoning"), normal), (tx.has_answer("reasoning"), answer), (tx.is_repetitive("reasoning"), _echoes("reasoning"))]
        pairs += [(tx.has_steps("reasoning", n), tx.step_count("reasoning") >= n) for n in (0, 1, 2, 5)]
        rows = rows.where("reasoning is not null")
        for i, (new, plain) in enumerate(pairs):
            assert rows.where(~new.eqNullSafe(plain)).count() == 0, i


def test_prefixes_hold_a_word_of_every_similar_set():
    rng = np.random.default_rng(5)
    vocabulary = rng.integers(-(2**62), 2**62, 400)
    long = dict(zip(vocabulary.tolist(), rng.integers(1, 20, 400).tolist(), strict=True))
    base = [rng.choice(vocabulary, n, replace=False) for n in (40, 60, 90) for _ in range(200)]
    near = [np.concatenate([rng.permutation(s)[: len(s) - 2], rng.choice(vocabulary, 1)]) for s in base]
    sets = [np.unique(s) for s in [np.zeros(0, np.int64), *base, *near]]
    known = np.sort(vocabulary[:100])
    frequent = known, np.arange(100) % 5 + 1
    for skip in (0, 3):
        hashes = pa.array(sets, pa.list_(pa.int64())).slice(skip)
        lengths = pa.array([[long[int(w)] for w in s] for s in sets], pa.list_(pa.int32())).slice(skip)
        found = [set(x) for x in clean._prefixes(hashes, lengths, 85, frequent).to_pylist()]
        assert [len(f) for f in found] == [len(s) - -(-len(s) * 85 // 100) + 1 if len(s) else 0 for s in sets[skip:]]
        assert all(f <= set(s.tolist()) for f, s in zip(found, sets[skip:], strict=True))
        for i in range(600):
            a, b = i + 1, i + 601
            both = len(set(sets[a].tolist()) & set(sets[b].tolist()))
            if a >= skip and both / (len(sets[a]) + len(sets[b]) - both) > 0.85:
                assert found[a - skip] & found[b - skip]


def test_evaluation_reads_verdicts_that_were_written(spark):
    from rollforge import jobs

    rows = spark.createDataFrame([("a", 0, "#### 1", "1"), ("a", 1, "#### 2", "1"), ("b", 0, "#### 3", "4")], "problem_id string, sample_idx long, reasoning string, expected string")
    found = jobs.evaluate(rows.select("problem_id").distinct(), rows, [1])
    assert "regexp_extract" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r.method: r.solved for r in found.collect()} == {"pass@1": 1, "verifier_guided": 1, "majority": 1}
