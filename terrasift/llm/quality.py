"""Quality by a support vector machine over n-grams scaled by their naive Bayes log-count ratios.

Indicators of n-grams of words, of their shapes, and of whether they repeat one of the two before, hashed into a fixed number of features, are scaled by the log-ratio of their
smoothed counts in the two classes; a linear hinge-loss model is fitted to them by dual coordinate descent, and its
margins are turned into probabilities on rows that it was not fitted to.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import labelled_sample, remainder
from .words import Words, distinct_by_row, mix, text_chunks, window_hashes

#: Labelled rows to fit on, features (a power of two), smoothing, penalty, passes over the rows, part kept for calibration.
ROWS, FEATURES, SMOOTHING, PENALTY, PASSES, CALIBRATION = 8192, 1 << 18, 1.0, 0.1, 10, 5
THRESHOLD = 0.3

#: 0 space, 1 letters and everything beyond ASCII, 2 digits, 3 other characters, 4 line feed.
_KINDS = np.full(256, 3, dtype=np.uint8)
_KINDS[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", *range(128, 256)]] = 1
_KINDS[[*b"0123456789"]] = 2
_KINDS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 0
_KINDS[0x0A] = 4


def _ngrams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(features, first): the distinct features of text i are features[first[i]:first[i + 1]]."""
    hashes, n = words.hashes(), len(words.start)
    rows = len(words.first) - 1
    if not n:
        return np.zeros(0, np.int64), np.zeros(rows + 1, np.int64)
    upper = np.concatenate(([0], np.cumsum((words.data >= 0x41) & (words.data <= 0x5A))))
    caps, size = upper[words.end] - upper[words.start], words.end - words.start
    kind = words.kind[words.start]
    shape = np.where(kind == 1, np.where(caps == 0, 1, np.where(caps == size, 2, 3)), np.where(kind == 2, 4, 5)).astype(np.uint64)
    shape = np.where((kind == 3) | (kind == 4), hashes, mix(shape))
    row, parts, owner = words.row_of_word(), [], []
    same = np.zeros(n, dtype=np.uint64)
    same[1:] += (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    same[2:] += np.uint64(2) * ((hashes[2:] == hashes[:-2]) & (row[2:] == row[:-2]))
    for source, width, salt in ((hashes, 1, 0), (hashes, 2, 0), (shape, 1, 1), (shape, 2, 1), (shape, 3, 1), (same, 4, 2)):
        grams = window_hashes(source, width) + np.uint64(salt)
        inside = row[: len(grams)] == row[width - 1 :][: len(grams)]
        parts.append((mix(grams[inside]) % np.uint64(FEATURES)).astype(np.int64))
        owner.append(row[: len(grams)][inside])
    return distinct_by_row(np.concatenate(parts), np.concatenate(owner), rows)


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    count = np.full((2, FEATURES), SMOOTHING)
    for features, label in zip(rows, y, strict=True):
        count[int(label), features] += 1
    return np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())


def hinge(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, penalty: float = PENALTY, passes: int = PASSES) -> tuple[np.ndarray, float]:
    """(weights, bias) of the L2-regularised hinge-loss model of indicators times scale, by dual coordinate descent.

    A row's penalty is inverse to its class's share. Every row's vector is scaled to length 1; the bias is a feature of
    value 1. Rows are visited in fixed shuffled orders, so fits agree.
    """
    sign = np.where(y == 1, 1.0, -1.0)
    ones = max(int((y == 1).sum()), 1)
    bound = np.where(y == 1, penalty * len(y) / (2 * ones), penalty * len(y) / (2 * max(len(y) - ones, 1)))
    values = [scale[r] / max(np.sqrt((scale[r] ** 2).sum()), 1e-12) for r in rows]
    square = np.array([(v * v).sum() + 1.0 for v in values])
    weights, bias, alpha, order = np.zeros(len(scale)), 0.0, np.zeros(len(y)), np.random.Generator(np.random.PCG64(1))
    for _ in range(passes):
        for i in order.permutation(len(y)):
            gradient = sign[i] * (weights[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), bound[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                weights[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
    return weights, bias


def calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a margin + b))), by Newton steps on smoothed targets."""
    ones, zeros = (y == 1).sum(), (y != 1).sum()
    goal = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - goal) * margin).sum() + 1e-3 * (a - 1), (p - goal).sum()])
        h = np.array([[(w * margin * margin).sum() + 1e-3, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


@dataclass
class Model:
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    a: float
    b: float

    def margin(self, features: np.ndarray) -> float:
        s = self.scale[features]
        return float((self.weights[features] @ s) / max(np.sqrt((s * s).sum()), 1e-12) + self.bias)

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * margin + self.b, -30, 30)))


def train(rows: list[np.ndarray], y: np.ndarray) -> Model:
    """A model of rows of feature numbers. With one class, or none, every score is the smoothed share of ones."""
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(np.zeros(FEATURES), np.zeros(FEATURES), 0.0, 1.0, float(np.log(share / (1 - share))))
    apart = np.arange(len(y)) % CALIBRATION == 0
    pick = lambda keep: ([r for r, k in zip(rows, keep, strict=True) if k], y[keep])
    part, own = pick(~apart) if len(set(y[~apart].tolist())) == 2 else (rows, y)
    scale = log_count_ratios(part, own)
    model = Model(scale, *hinge(part, own, scale), 1.0, 0.0)
    a, b = calibrate(np.array([model.margin(r) for r in pick(apart)[0]]), y[apart])
    return Model(model.scale, model.weights, model.bias, a, b)


def _features(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    for low, high, data, offsets in text_chunks(column):
        features, first = _ngrams(Words(data, offsets, _KINDS, lower=False))
        for i in range(high - low):
            yield low + i, features[first[i] : first[i + 1]]


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [f.astype(np.int32).tobytes() for _, f in _features(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array(found, pa.binary())], ["id", "y", "features"])


def fit(docs: DataFrame, labels: DataFrame, usable, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model fitted to at most ROWS labelled documents for which usable, a condition on labels, holds."""
    sample = labelled_sample(docs, labels, label, usable, ROWS, id_col, text_col).select(F.col("id").cast("string").alias("id"), "text", "y")
    rows = sorted(sample.mapInArrow(_sample_features, "id string, y int, features binary").collect())
    return train([np.frombuffer(r.features, dtype=np.int32).astype(np.int64) for r in rows], np.array([r.y for r in rows], dtype=np.int64))


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, margin, score) for every row of docs; a null or empty text has no n-grams and gets the bias's score.
    Other columns are not read; rows may repeat."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            margin = np.full(len(batch), own.bias)
            for row, features in _features(batch.column("text")):
                margin[row] = own.margin(features)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(margin), pa.array(own.score(margin))], ["id", "margin", "score"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, f"id {dict(texts.dtypes)['id']}, margin double, score double").withColumnRenamed("id", id_col)


def learnable(id_col: str = "doc_id"):
    """Rows whose labels may be learned from."""
    return F.coalesce(remainder(id_col, 5) != 0, F.lit(True))
