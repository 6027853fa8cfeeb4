"""Pairs that cannot link fetch no texts."""

import numpy as np
from pyspark.sql import types as T

from rollforge.llm import ngram_join


def test_only_pairs_that_may_link_are_fetched(spark):
    rng = np.random.default_rng(5)
    sets, pairs, link = {}, [], set()
    for i, (n, shared) in enumerate([(5, 4), (60, 57), (60, 30), (400, 370), (400, 100), (1499, 1400), (1499, 300), (1600, 1500), (1600, 200), (5000, 900)]):
        both = np.unique(rng.integers(0, 2**63, 2 * n, dtype=np.uint64))
        a, b = np.sort(both[:n]), np.sort(np.concatenate([both[:shared], both[n : 2 * n - shared]]))
        sets |= {2 * i: a, 2 * i + 1: b}
        pairs.append((2 * i, 2 * i + 1))
        if len(np.intersect1d(a, b)) >= ngram_join.needed(len(a), len(b)):
            link.add(2 * i)
    rows = [(node, node, len(s), ngram_join.sketch_of(s).tolist()) for node, s in sets.items()]
    heads = spark.createDataFrame(rows, "node long, head long, n int, sketch array<long>")
    kept = {r.query for r in ngram_join.may_link(spark.createDataFrame(pairs, "query long, node long"), heads).collect()}
    assert link <= kept and len(link) == 4
    # shingles of 400 and more that share a quarter or less are told apart by their sketches
    assert not kept & {8, 12, 16, 18}


def test_the_largest_sets_have_no_sketch_and_stay(spark):
    assert ngram_join.sketch_of(np.arange(25_001, dtype=np.uint64)) is None
    kind = T._parse_datatype_string("node long, head long, n int, sketch array<long>")
    heads = spark.createDataFrame([(1, 1, 30_000, None), (2, 2, 29_000, None), (3, 3, 24_000, [0] * 256), (4, 4, 10, [0] * 16)], kind)
    kept = ngram_join.may_link(spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "query long, node long"), heads)
    assert {tuple(r) for r in kept.collect()} == {(1, 2), (1, 3)}
