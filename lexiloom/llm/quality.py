"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Features of a text are shares of its n-grams, n = 1 and 2, once over its words as they are and once over
the words' shapes (case, digits, marks, length, equal to the word before), hashed to DIMENSIONS places. A
score is the sparse dot product of the shares with the weights, through the logistic function.

Training takes a bounded sample: the TRAIN_ROWS labelled rows of smallest hash among those allowed, whatever the
corpus; their features come to the driver (some tens of MB) and go through FTRL-proximal updates row by
row. Every row of the table is scored, over its whole text.

Defined results: a null, empty or blank text has no n-grams, so its score is that of the bias alone; without labels
every score is 0.5; of labels that repeat an id the smallest counts; repeated rows give repeated rows;
other columns of the inputs are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .repeats import Units, cut_units, mix

DIMENSIONS = 1 << 18
TRAIN_ROWS = 4000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-3
SCALE = np.float32(8)
SEEDS = np.array([0x51ED270B, 0x2545F491, 0x9E3779B9, 0x85EBCA6B], np.uint64)
UNITS = Units(words=True, k=1, m=1)
SCHEMA = "doc_id long, score double, predicted int"


def _shapes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    kind = np.zeros(256, np.uint8)
    kind[ord("a") : ord("z") + 1], kind[ord("A") : ord("Z") + 1], kind[ord("0") : ord("9") + 1], kind[128:] = 1, 2, 3, 4
    of = kind[raw]
    n = (ends - starts).astype(np.uint64)
    count = lambda k: np.diff(np.r_[0, np.cumsum(of == k)][np.c_[starts, ends]], axis=1)[:, 0].astype(np.uint64)
    upper, lower, digit, high = count(2), count(1), count(3), count(4)
    marks = n - upper - lower - digit - high
    same = np.zeros(len(codes), np.uint64)
    same[1:] = codes[1:] == codes[:-1]
    same[first[first < len(codes)]] = 0
    last = np.where(of[ends - 1] == 0, raw[ends - 1], 0).astype(np.uint64)
    few = lambda x, k: np.minimum(x, np.uint64(k))
    return few(n, 15) | few(upper, 3) << np.uint64(4) | few(lower, 1) << np.uint64(8) | few(digit, 2) << np.uint64(9) | few(marks, 3) << np.uint64(12) | same << np.uint64(16) | last << np.uint64(20) | (of[starts] == 2).astype(np.uint64) << np.uint64(30)


def features(data: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place and share of each n-gram (repeats apart), text after text, and where each text's begin (with the end)."""
    cut = cut_units(UNITS, data, bounds)
    sizes = np.diff(cut.bounds)
    if not len(cut.codes):
        return np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(len(bounds), np.int64)
    first = cut.bounds[:-1][sizes > 0]
    shape = _shapes(np.frombuffer(data, np.uint8), cut.starts, cut.ends, cut.codes, first)
    rows = [cut.codes ^ SEEDS[0], shape ^ (SEEDS[1] << np.uint64(33))]
    for k, seed in ((0, SEEDS[2]), (1, SEEDS[3])):
        pair = rows[k].copy()
        pair[1:] += rows[k][:-1] * np.uint64(0xC2B2AE3D27D4EB4F)
        pair[first] = 1  # the first word follows nothing
        rows.append(pair ^ (seed << np.uint64(31)))
    place = np.stack([mix(r) & np.uint64(DIMENSIONS - 1) for r in rows], axis=1).astype(np.int32).ravel()
    share = np.repeat(SCALE / np.maximum(sizes, 1).astype(np.float32), 4 * sizes)
    return place, share, 4 * cut.bounds


class Ftrl:
    """Follow-the-regularised-leader, proximal form, with a bias at the last place."""

    def __init__(self, size: int = DIMENSIONS + 1) -> None:
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA * w
        self.n[at] += g * g


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """rows: distinct places, their values and the label. Weights as 32-bit floats, the bias last."""
    model = Ftrl()
    for k in range(epochs):
        for i in np.random.default_rng(k).permutation(len(rows)):
            at, x, label = rows[i]
            model.learn(np.r_[at, DIMENSIONS], np.r_[x, 1.0], label)
    return model.weights(np.arange(DIMENSIONS + 1)).astype(np.float32)


def sample(docs: DataFrame, labels: DataFrame, allowed: Column, rows: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Features of the labelled rows to train on, by their hash."""
    chosen = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where(allowed)
    chosen = chosen.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    both = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality")

    def run(batches):
        for batch in C.text_slices(batches):
            data, bounds = C.utf8(batch.column("text"))
            place, share, starts = features(data, bounds)
            at, x = [], []
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                own, back = np.unique(place[a:b], return_inverse=True)
                at.append(own.tobytes())
                x.append(np.bincount(back, share[a:b], len(own)).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(at, pa.binary()), pa.array(x, pa.binary())], ["doc_id", "quality", "at", "x"])

    found = both.mapInArrow(run, "doc_id long, quality int, at binary, x binary").toArrow()
    got = sorted(zip(*(found.column(c).to_pylist() for c in found.column_names), strict=True))
    return [(np.frombuffer(at, np.int32), np.frombuffer(x, np.float32).astype(np.float64), int(q > 0)) for _, q, at, x in got]


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _scorer(weights):
    """Scores of a text column."""
    w = weights.value

    def score(column: pa.Array) -> np.ndarray:
        place, share, starts = features(*C.utf8(column))
        total = np.r_[0.0, np.cumsum(w[place].astype(np.float64) * share)]
        z = np.clip(total[starts[1:]] - total[starts[:-1]] + w[-1], -30, 30)
        return np.round(1 / (1 + np.exp(-z)), 12)

    return score


def fitted(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS):
    """The weights, broadcast (1 MB, whatever the corpus); labels of held_out() rows are never read."""
    labels = labels.select("doc_id", F.col("quality").cast("int").alias("quality"))
    return docs.sparkSession.sparkContext.broadcast(train(sample(C.texts(docs), labels, ~held_out(F.col("doc_id")), train_rows)))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, score and predicted of every row; learns only from labels outside held_out()."""
    weights = fitted(docs, labels, train_rows)

    def one():
        score = _scorer(weights)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            s = score(batch.column("text"))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

        return each

    return C.map_texts(C.texts(docs), one, SCHEMA)


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of docs, with all their columns, that score the threshold or more."""
    weights = fitted(docs, labels, train_rows)

    def one():
        score = _scorer(weights)
        return lambda batch: batch.filter(pa.array(score(batch.column("text")) >= threshold))

    return C.map_texts(docs, one, docs.schema)
