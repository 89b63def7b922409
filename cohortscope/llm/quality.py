"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL.

Features are words, word pairs, word outlines and pairs of outlines, hashed into ``2**BITS`` weights;
a text is the unit vector of the logarithms of their counts. Follow-the-regularised-leader keeps two
numbers per weight and leaves most weights at exactly zero. Training sees at most ``MAX_ROWS`` labelled
texts of the learning folds, the ones whose ids have the smallest hashes, of ``MAX_BYTES`` together, and runs on
the driver over their feature indices; scoring is a sparse dot product in each task, with the weights sent along once
(``8 * 2**BITS`` bytes at most).

Defined results: null, empty and white-space texts have no feature and get the score of the bias;
without any labelled row, or a text of it of at most ``MAX_BYTES``, every score is 0.5, and with one label only the scores lean to it; repeated
labels of an id count as one, the largest; a null ``doc_id`` is in no held-out fold; repeated rows are
scored each; an empty table gives no rows. ``score_quality`` passes all other columns through and
replaces one named ``score``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortscope.llm.base import query, table
from cohortscope.llm.features import (
    MAX_BYTES,
    Sparse,
    extract,
    fold_columns,
    labelled,
    packed,
    scored,
    shape_number,
    word_number,
)

BITS = 20
MAX_ROWS = 8_000
THRESHOLD = 0.7
SCALE = 5.0


def featurise(texts: pa.Array) -> Sparse:
    return extract(texts, BITS, [(word_number, 2), (shape_number, 2)], repeats=True)


def values(x: Sparse) -> np.ndarray:
    """Unit vectors of log counts, times ``SCALE``."""
    v = np.log1p(x.counts)
    norm = np.sqrt(np.bincount(x.rows, v * v, minlength=x.n))
    return SCALE * v / norm[x.rows]


class Ftrl:
    """Per-coordinate follow-the-regularised-leader for logistic loss, with a bias."""

    def __init__(self, size: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-4):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, index) -> np.ndarray:
        z, n = self.z[index], self.n[index]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0.0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, index: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(index)
        gradient = (1.0 / (1.0 + np.exp(-np.clip(w @ x, -40, 40))) - label) * x
        sigma = (np.sqrt(self.n[index] + gradient**2) - np.sqrt(self.n[index])) / self.alpha
        self.z[index] += gradient - sigma * w
        self.n[index] += gradient**2


def train(parts: list[tuple], epochs: int = 2, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias from packed features with labels (the last array of each part)."""
    size = 1 << BITS
    model, examples = Ftrl(size), []
    for sizes, index, counts, *_, labels in parts:
        x = Sparse(len(sizes), np.repeat(np.arange(len(sizes)), sizes), index, counts)
        v, ends = values(x).astype(np.float32), np.cumsum(sizes)
        examples += [
            (index[e - s : e], v[e - s : e], int(label > 0))
            for s, e, label in zip(sizes.tolist(), ends.tolist(), labels, strict=True)
        ]
    shuffle = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in shuffle.permutation(len(examples)):
            index, x, label = examples[i]
            model.learn(np.append(index, size), np.append(x, np.float32(1.0)), label)
    w = model.weights(slice(None))
    return w[:size], float(w[size])


def fit(
    docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES
) -> Callable[[Sparse], np.ndarray]:
    """A score function learnt from ``labels`` (doc_id, quality) outside the held-out fold."""
    sample = labelled(docs, labels, "quality", max_rows, max_bytes)
    weights, bias = train(packed(sample, featurise, "h", "label"))
    used = np.flatnonzero(weights)
    held = weights[used].astype(np.float32)

    def score(x: Sparse) -> np.ndarray:
        at = np.minimum(np.searchsorted(used, x.index), max(len(used) - 1, 0))
        w = np.where(used[at] == x.index, held[at], 0.0) if len(used) else np.zeros(len(x.index))
        margin = np.bincount(x.rows, values(x) * w, minlength=x.n) + bias
        return 1.0 / (1.0 + np.exp(-np.clip(margin, -40, 40)))

    return score


def score_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """``docs`` (doc_id, text, ...) with ``score``: the probability of label 1."""
    return scored(docs, featurise, fit(docs, labels, max_rows))


@query("op7_quality")
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score_quality(docs, table(spark, sf_dir, "labels"))
    return found.select(
        "doc_id", fold_columns(F.col("doc_id")), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
