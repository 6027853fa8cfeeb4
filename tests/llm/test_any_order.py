"""The order of shingles that a sample gives changes what a join costs, never what it finds."""

import numpy as np
import pyarrow as pa

from rollforge.llm import ngram_join
from rollforge.llm.textkit import shingle_sets


def test_classes_do_not_depend_on_the_sampled_order(spark, sf_dir, monkeypatch):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words[:40]), " ".join(words[:39] + ["x"]), " ".join(words[2:42]), " ".join(words[20:60]), " ".join(words[19:59]), "a b c", "a b c", " ".join(words[:25])]
    near = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(near).coalesce(2).cache()
    found = [s for _, s in shingle_sets(pa.array([r.text for r in docs.collect()], pa.string()), ngram_join.K)]
    every = np.unique(np.concatenate(found))
    sets = {}
    for r, (row, s) in zip(docs.collect(), shingle_sets(pa.array([r.text for r in docs.collect()], pa.string()), ngram_join.K), strict=True):
        sets[r.doc_id] = frozenset(s.tolist())
    linked = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    own = {d: d for d in sets}
    for _ in sets:
        for a, b in linked:
            own[a] = own[b] = min(own[a], own[b])
    assert len(set(own.values())) < len(own)
    # no frequent shingle at all, and every shingle in a random sequence, each list in several parts
    orders = [ngram_join.Order(every[:0], np.zeros(0, np.int64)), ngram_join.Order(every, np.random.default_rng(7).permutation(len(every)) + 1, 1e-6)]
    for order in orders:
        monkeypatch.setattr(ngram_join, "frequent_shingles", lambda *_, order=order: order)
        assert {r.doc_id: r.component_id for r in ngram_join.similarity_classes(docs).collect()} == own
