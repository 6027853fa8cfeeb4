"""Quality by Bradley-Terry ranking: scores learned from preference pairs, cut at a score quantile.

A text's features are shares and averages over the whole text (letters, capitals, digits, signs, blanks, word lengths,
distinct and repeated words, repeated lines) and their squares, standardised. From labelled rows every pair of a good
and a poor text is a preference; a bounded sample of texts (max_train) and of pairs (max_pairs) is drawn by hashes of
doc_id. The chance that one text is preferred is the logistic function of the difference of their scores, so logistic
loss on feature differences gives the weights. Every text is scored once, and the scores are written. The cut is a
quantile, read to a thousandth, of the scores of all labelled rows outside the held-out fold: the share of poor ones among them. A logistic curve through the cut at 0.7 maps scores to 0 to 1.

Null and empty texts have all features 0 and are scored like any other. Repeated rows are scored each. Without labelled
rows of both classes every score is 0.5. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollforge.llm.shared import remove, slices, written
from rollforge.llm.toxicity import held_out, training_rows
from rollforge.operators.ordinals import numbered

MAX_TRAIN, MAX_TRAIN_CHARS, MAX_PAIRS, THRESHOLD = 4000, 20_000, 40_000, 0.7
_CLASSES = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 blank, 5 line end, 6 sentence mark, 7 sign, 8 beyond ASCII
for _low, _high, _kind in ((97, 122, 1), (65, 90, 2), (48, 57, 3), (33, 47, 7), (58, 64, 7), (91, 96, 7), (123, 126, 7), (128, 255, 8)):
    _CLASSES[_low : _high + 1] = _kind
for _char, _kind in ((" ", 4), ("\t", 4), ("\n", 5), (".", 6), (",", 6), ("?", 6), (";", 6), (":", 6)):
    _CLASSES[ord(_char)] = _kind
_CAPITALS = re.compile(r"\b[^\W\d_a-z]{2,}\b")
N_BASE = 16


def features(text: str | None) -> np.ndarray:
    """N_BASE numbers, each about 0 to 1."""
    text = text or ""
    words = text.split()
    if not words:
        return np.zeros(N_BASE)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kinds = np.bincount(_CLASSES[raw], minlength=9) / len(raw)
    n = len(words)
    counts = Counter(words)
    adjacent = sum(map(str.__eq__, words, words[1:])) / n
    lines = text.split("\n")
    return np.array([
        kinds[1] + kinds[8], kinds[2], kinds[3], kinds[4], kinds[5], kinds[6], kinds[7],
        min(1.0, sum(map(len, words)) / n / 16), len(counts) / n, max(counts.values()) / n, adjacent,
        1 - len(set(lines)) / len(lines), min(1.0, np.log1p(n) / 12), len(_CAPITALS.findall(text)) / n,
        sum(1 for w, c in counts.items() if c == 1) / n, min(1.0, n / 20),
    ])


def matrix(texts: list[str | None]) -> np.ndarray:
    base = np.array([features(t) for t in texts]).reshape(len(texts), N_BASE)
    return np.hstack([base, base * base, base[:, 8:9] * base[:, 12:13], np.sqrt(base[:, [6, 9, 10]])])


@dataclass
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float = 0.0
    spread: float = 1.0

    def raw(self, texts: list[str | None]) -> np.ndarray:
        return ((matrix(texts) - self.mean) / self.scale) @ self.weights


def fit(x: np.ndarray, labels: np.ndarray, max_pairs: int = MAX_PAIRS, rounds: int = 400, l2: float = 1e-3) -> Ranker:
    """Weights from (good, poor) pairs; the cut is set by the caller."""
    good, poor = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    width = matrix([]).shape[1]
    if not len(good) or not len(poor):
        return Ranker(np.zeros(width), np.ones(width), np.zeros(width))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = (x - mean) / scale
    all_pairs = len(good) * len(poor)
    pick = np.arange(all_pairs) if all_pairs <= max_pairs else np.random.default_rng(11).choice(all_pairs, max_pairs, replace=False)
    d = z[good[pick // len(poor)]] - z[poor[pick % len(poor)]]
    w, m, v = np.zeros(width), np.zeros(width), np.zeros(width)
    for step in range(1, rounds + 1):
        grad = -(d.T @ (1.0 / (1.0 + np.exp(np.clip(d @ w, -30, 30))))) / len(d) + l2 * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w = w - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return Ranker(mean, scale, w)


def raw_scores(docs: DataFrame, ranker: Ranker, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, raw of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(ranker)

    def score(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(shared.value.raw(batch.column(1).to_pylist()), pa.float64())], ["doc_id", "held_out", "raw"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), held_out(id_col).alias("held_out")).mapInArrow(score, "doc_id long, held_out boolean, raw double")


def with_cut(ranker: Ranker, scored: DataFrame, labels: DataFrame, label: str = "quality") -> Ranker:
    """The cut over the scores of all labelled rows outside the held-out fold. scored: doc_id, raw (a written table).

    Scores are numbered in order, and those at 1,001 even places from the lowest to the highest are read, whatever the
    number of rows (of fewer rows each is read, some for several places). Between the two classes' scores at the quantile
    the cut lies in the middle of the widest gap nearby, so that texts of one kind are not split by it.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col(label).cast("int").alias("label")).dropna().where(~held_out("label_id")).groupBy("label_id").agg(F.max("label").alias("label"))
    judged = scored.select("doc_id", "raw").hint("merge").join(known.hint("merge"), F.col("doc_id") == F.col("label_id")).select("raw", "label")
    placed = written(numbered(judged, [], ["raw"]), "placed")
    row = placed.agg(F.avg((F.col("label") == 0).cast("double")).alias("poor"), F.stddev_pop("raw").alias("spread"), F.count("*").alias("n")).first()
    if not row.n:
        return ranker
    step = (F.col("place_n") - 1) / 1000.0
    nearest = placed.where(F.floor(F.ceil(F.col("place") / F.greatest(step, F.lit(1e-12))) * step) == F.col("place"))
    at = {r.place: r.raw for r in nearest.select("place", "raw").collect()}
    marks = np.array([at[min(at, key=lambda p: abs(p - i * (row.n - 1) / 1000.0))] for i in range(1001)])
    share = lambda x: min(len(marks) - 1, max(0, round(x * (len(marks) - 1))))
    low, high = share(row.poor - 0.015), share(row.poor + 0.015)
    gaps = np.diff(marks[low : high + 1])
    k = low + int(gaps.argmax()) if len(gaps) else share(row.poor)
    cut = float((marks[k] + marks[min(len(marks) - 1, k + 1)]) / 2)
    remove(placed)
    return Ranker(ranker.mean, ranker.scale, ranker.weights, cut, max(1e-6, float(row.spread or 1.0) / 4))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_train: int = MAX_TRAIN, max_train_chars: int = MAX_TRAIN_CHARS) -> Ranker:
    """The weights; with_cut sets the cut."""
    rows = training_rows(docs, labels, label, max_train, max_train_chars).collect()
    rows.sort(key=lambda r: (r.doc_id, r.text))
    return fit(matrix([r.text for r in rows]), np.array([r.label for r in rows]))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", max_train: int = MAX_TRAIN, max_train_chars: int = MAX_TRAIN_CHARS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Every text is read once for its raw score, which is written."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ranker = train(named, labels, label, max_train, max_train_chars)
    raw = written(raw_scores(named, ranker), "raw")
    if ranker.weights.any():
        ranker = with_cut(ranker, raw, labels, label)
    at = float(np.log(THRESHOLD / (1 - THRESHOLD))) if ranker.weights.any() else 0.0
    margin = F.least(F.greatest((F.col("raw") - ranker.cut) / ranker.spread + at, F.lit(-30.0)), F.lit(30.0))
    scored = raw.select("doc_id", "held_out", (1 / (1 + F.exp(-margin))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
