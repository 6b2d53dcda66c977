"""Quality by pairwise ranking: a Bradley-Terry model of features, cut at a score quantile."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scoring import labelled_sample, score_column

#: Labelled rows from which the model is learned, and preference pairs for each worse row, at most.
SAMPLE_ROWS, PAIRS = 30_000, 8
#: A text is kept from this score on.
THRESHOLD = 0.7

UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"
SIGNS = b"#$%&*@^~<>{}[]_=+\\/"
LOUD = b"!"
BARS = b"|"
STOPS = b".,;:"
FEATURES = 13 * 2


def measure(text: str) -> list[float]:
    """Shares that tell how a text is written, each also by its square root. No words count as such."""
    raw = text.encode()
    words, lines = text.split(), text.split("\n")
    size, n = max(1, len(raw)), max(1, len(words))

    def share(signs: bytes) -> float:
        return (len(raw) - len(raw.translate(None, signs))) / size

    common = Counter(words).most_common(1)[0][1] if words else 0
    shares = [
        share(UPPER), share(DIGITS), share(SIGNS), share(LOUD), share(BARS), share(STOPS),
        sum(map(eq, words, words[1:])) / n, common / n if n > 20 else 0.0, 1 - len(set(words)) / n,
        1 - len(set(lines)) / len(lines), min(1.0, len(lines) / n), min(1.0, n / size), min(1.0, math.log1p(len(words)) / 12),
    ]
    return shares + [math.sqrt(x) for x in shares]


def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [measure(x or "") for x in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(rows, pa.list_(pa.float64()))], ["label", "features"])


def fit_preferences(better: np.ndarray, worse: np.ndarray, penalty: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights that make score differences likely under the logistic loss, by Newton's method."""
    d = better - worse
    w = np.zeros(d.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        gradient = d.T @ p - penalty * w
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + penalty * np.eye(len(w)), gradient)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


class QualityModel:
    """``scorer()`` gives the function of one text: its Bradley-Terry score, moved so that the cut is at THRESHOLD."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, weights: np.ndarray, cut: float) -> None:
        self.mean, self.spread, self.weights, self.cut = mean, spread, weights, cut

    def raw(self, features: np.ndarray) -> np.ndarray:
        return np.clip((features - self.mean) / self.spread, -8, 8) @ self.weights

    def scorer(self):
        at = math.log(THRESHOLD / (1 - THRESHOLD))

        def score(text: str) -> float:
            z = float(self.raw(np.array(measure(text)))) - self.cut + at
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

        return score


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> QualityModel:
    """Learn from at most ``rows`` labelled rows: ``docs`` (doc_id, text), ``labels`` (doc_id, quality).

    Each row of label 0 loses to up to ``PAIRS`` rows of label 1; a text's score is
    linear in its features. The cut is the quantile of the sample's scores at the share of
    label 0, in the middle of the gap around it. With one label only, or none, every text has the same score, just kept.
    """
    found = labelled_sample(docs, labels, "quality", rows).mapInArrow(measured, "label int, features array<double>").collect()
    x = np.array([r["features"] for r in found]).reshape(-1, FEATURES)
    y = np.array([r["label"] for r in found])
    if len(set(y.tolist())) < 2:
        return QualityModel(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), 0.0)
    order = np.lexsort(np.c_[x, y].T)  # whatever order the rows came in
    x, y = x[order], y[order]
    model = QualityModel(x.mean(axis=0), x.std(axis=0) + 1e-9, np.zeros(FEATURES), 0.0)
    scaled = np.clip((x - model.mean) / model.spread, -8, 8)
    good, bad = scaled[y == 1], scaled[y == 0]
    drawn = np.random.default_rng(11).integers(0, len(good), (PAIRS, len(bad)))
    model.weights = fit_preferences(good[drawn].reshape(-1, FEATURES), np.tile(bad, (PAIRS, 1)))
    scores, share = model.raw(x), float((y == 0).mean())
    model.cut = float(np.quantile(scores, [share * 0.98, share + (1 - share) * 0.005]).mean())
    return model


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (score >= 0.7); whole texts, null as empty. The columns score and predicted are replaced."""
    return docs.withColumn("score", score_column(model.scorer)).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
