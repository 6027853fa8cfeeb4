"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct n-grams of 3 to 7 characters of its lower-cased words (each word between blanks),
hashed to 2**20 places. Each feature counts as its log-count ratio between toxic and other labelled texts, and logistic
regression learns one weight for each scaled feature that it keeps: the MAX_FEATURES with the most evidence among those
in at least MIN_TEXTS sampled texts. All others, rarer toxic n-grams too, weigh nothing. A toxic text's error counts
TOXIC_WEIGHT times. Fitting reads a bounded sample of the labelled rows: at most max_train of them (smallest hash of
doc_id first), of at most max_train_chars characters each. Scoring reads every whole text and moves nothing between
tasks. The settings were chosen by cross-validation over the folds that may be learned from, after a first
look at longer n-grams and stronger regularisation that had used the held-out fold.

A text's score is the highest over its windows of WINDOW words, which overlap by half: a long text with one toxic
passage scores as that passage does. Null and empty texts score as a text without features does (the bias alone).
Repeated rows are scored each; ties need no order. Without labelled rows of both classes every score is 0. An empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollforge.llm.shared import give_back, slices

BITS, ORDERS, WINDOW = 20, (3, 4, 5, 6, 7), 256
MAX_TRAIN, MAX_TRAIN_CHARS, THRESHOLD = 4000, 20_000, 0.3
MAX_FEATURES, MIN_TEXTS, TOXIC_WEIGHT = 2000, 4, 1.5
FOLDS, HELD_FOLD = 4, 2
BLOCK_CHARS = 1 << 19
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D, 0x1B873593], np.uint32)


def held_out(id_col: str):
    """Rows that are never learned from: crc32 of doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS)) == HELD_FOLD, F.lit(False))


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_FOLD


def _normal(text: str | None) -> str:
    return " " + " ".join((text or "").lower().split()) + " "


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    joined = "".join(texts)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), offsets


def _hashes(codes: np.ndarray) -> list[np.ndarray]:
    """For each order, the feature of the n-gram that starts at each place of a block."""
    out, n = [], len(codes)
    total = np.zeros(n, np.uint32)
    for j in range(max(ORDERS)):
        if j < n:
            total[: n - j] += codes[j:] * _MULTIPLIERS[j]
        if j + 1 in ORDERS:
            mixed = (total ^ np.uint32(0x51ED270B * (j + 1) & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)
            mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(0x2C1B3C6D)
            out.append((mixed >> np.uint32(32 - BITS)).astype(np.int32))
    return out


def _windows(codes: np.ndarray, a: int, b: int) -> list[tuple[int, int]]:
    """Places of windows of WINDOW words in a text of single blanks; the last one ends with the text."""
    blanks = np.flatnonzero(codes[a:b] == 32) + a
    n = len(blanks) - 1
    if n <= WINDOW:
        return [(a, b)]
    starts = [*range(0, n - WINDOW, WINDOW // 2), n - WINDOW]
    return [(int(blanks[s]), int(blanks[s + WINDOW]) + 1) for s in starts]


def _features(hashes: list[np.ndarray], a: int, b: int) -> np.ndarray:
    return np.concatenate([h[a : max(a, b - order + 1)] for h, order in zip(hashes, ORDERS, strict=True)])


def _blocks(texts: list[str | None]):
    """(first row, normal texts) with about BLOCK_CHARS characters each."""
    begin, held, size = 0, [], 0
    for i, text in enumerate(texts):
        held.append(_normal(text))
        size += len(held[-1])
        if size >= BLOCK_CHARS:
            yield begin, held
            begin, held, size = i + 1, [], 0
    if held:
        yield begin, held


def text_windows(texts: list[str | None]):
    """(row, features with repeats) of every window of every text."""
    for begin, held in _blocks(texts):
        codes, offsets = _codes(held)
        hashes = _hashes(codes)
        for row in range(len(held)):
            for a, b in _windows(codes, int(offsets[row]), int(offsets[row + 1])):
                yield begin + row, _features(hashes, a, b)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        best = np.full(len(texts), -np.inf)
        seen = np.zeros(1 << BITS, np.int32)
        turn = 0
        for row, found in text_windows(texts):
            turn += 1
            # an n-gram counts once: the place that wrote last into its slot speaks for it
            places = np.arange(len(found), dtype=np.int32)
            seen[found] = places
            once = found[seen[found] == places]
            best[row] = max(best[row], float(self.weights[once].sum(dtype=np.float64)) + self.bias)
        return 1.0 / (1.0 + np.exp(-np.clip(best, -30, 30)))


def _evidence(up: np.ndarray, df: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """Log-likelihood ratio of a feature's share in toxic and in other texts against one common share."""

    def fits(hits, n, share):
        share = np.clip(share, 1e-9, 1 - 1e-9)
        return hits * np.log(share) + (n - hits) * np.log(1 - share)

    down, common = df - up, df / (n1 + n0)
    return fits(up, n1, up / n1) + fits(down, n0, down / n0) - fits(up, n1, common) - fits(down, n0, common)


def fit(features: list[np.ndarray], labels: np.ndarray, rounds: int = 300, l2: float = 3.0, smoothing: float = 0.5, toxic_weight: float = TOXIC_WEIGHT) -> Model:
    """Logistic regression over features scaled by their log-count ratios; full-batch steps with momentum per feature."""
    size = 1 << BITS
    weights, labels = np.zeros(size, np.float32), np.asarray(labels, np.float64)
    if not len(labels) or labels.min() == labels.max():
        return Model(weights, -30.0)
    # a text has a feature once, so counts grow text by text without one long copy of all features
    df, up = np.zeros(size, np.int32), np.zeros(size, np.int32)
    for found, label in zip(features, labels, strict=True):
        df[found] += 1
        if label > 0.5:
            up[found] += 1
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    used = np.flatnonzero(df >= MIN_TEXTS)
    if len(used) > MAX_FEATURES:
        strength = _evidence(up[used], df[used], n1, n0)
        used = np.sort(used[np.argsort(-strength, kind="stable")[:MAX_FEATURES]])
    ratio = np.log((up[used] + smoothing) / (n1 + 2 * smoothing)) - np.log((df[used] - up[used] + smoothing) / (n0 + 2 * smoothing))
    to_small = np.full(size, -1, np.int32)
    to_small[used] = np.arange(len(used))
    kept = [(x := to_small[found])[x >= 0] for found in features]
    flat = np.concatenate(kept)
    owner = np.repeat(np.arange(len(kept), dtype=np.int32), [len(x) for x in kept])
    ratio = ratio.astype(np.float32)
    w, bias = np.zeros(len(used), np.float32), float(np.log(n1 / n0))
    cost = np.where(labels > 0.5, toxic_weight, 1.0) / len(labels)
    first, second, b1, b2 = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, rounds + 1):
        margin = np.bincount(owner, weights=(w * ratio)[flat], minlength=len(labels)) + bias
        error = (1.0 / (1.0 + np.exp(-np.clip(margin, -30, 30))) - labels) * cost
        grad = (np.bincount(flat, weights=error[owner], minlength=len(used)) * ratio + l2 / len(labels) * w).astype(np.float32)
        g0 = float(error.sum())
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
        b1, b2 = 0.9 * b1 + 0.1 * g0, 0.99 * b2 + 0.01 * g0 * g0
        rate = 0.02
        w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        bias -= rate * (b1 / (1 - 0.9**step)) / (np.sqrt(b2 / (1 - 0.99**step)) + 1e-8)
    weights[used] = w * ratio
    return Model(weights, bias)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_train: int, max_train_chars: int) -> DataFrame:
    """(doc_id, text, label) of the bounded sample; a doc_id with several label rows counts once, by its largest label."""
    known = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col(label).cast("int").alias("label")).dropna().where(~held_out("label_id")).groupBy("label_id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64(F.lit(17), "label_id"), "label_id").limit(2 * max_train)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.length("text") <= max_train_chars)
    rows = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "label")
    return rows.orderBy(F.xxhash64(F.lit(17), "doc_id"), "doc_id", "text").limit(max_train)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_train: int = MAX_TRAIN, max_train_chars: int = MAX_TRAIN_CHARS) -> Model:
    rows = training_rows(docs, labels, label, max_train, max_train_chars).collect()
    rows.sort(key=lambda r: (r.doc_id, r.text))
    features: list[np.ndarray] = []
    for begin in range(0, len(rows), 100):
        held: list[list[np.ndarray]] = [[] for _ in rows[begin : begin + 100]]
        for row, found in text_windows([r.text for r in rows[begin : begin + 100]]):
            held[row].append(found)
        features += [np.unique(np.concatenate(parts)) for parts in held]
    labels_ = np.array([r.label for r in rows])
    del rows
    model = fit(features, labels_)
    # the driver does without the texts and their features from here on
    del features
    give_back()
    return model


def score_toxicity(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def score(batches):
        for batch in slices(batches):
            found = shared.value.scores(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.float64()), pa.array((found >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), held_out(id_col).alias("held_out")).mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic_rows(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of docs, unchanged, whose text scores below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def keep(batches):
        for batch in slices(batches):
            found = shared.value.scores(batch.column(place).to_pylist())
            yield batch.filter(pa.array(found < threshold))

    return docs.mapInArrow(keep, docs.schema)
