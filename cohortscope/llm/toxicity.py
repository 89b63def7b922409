"""Toxicity classifier by non-negative positive-unlabelled learning.

It learns from confirmed toxic texts and from unlabelled texts, never from texts called clean. With the
class prior p, the risk of a score function is ``p * loss(positive, 1) + (loss(unlabelled, 0) - p *
loss(positive, 0))``; the part in brackets estimates the risk on clean texts, which can't be below zero.
Where a batch makes it negative, the model fits the unlabelled texts too closely, and the step goes
uphill on that part instead. The prior is the share of toxic rows among the labelled rows of the
learning folds.

Features say which words, and which first five letters of words, a text has, hashed into ``2**BITS``
buckets. Only buckets that confirmed toxic texts have clearly more often than unlabelled ones
(by ``MIN_Z`` standard deviations), and whose texts are toxic in a share of at least ``MIN_SHARE`` by the prior,
get a weight. Copies of a text count once. Training is a numpy job on the driver over feature indices
of at most ``MAX_POSITIVE`` and ``MAX_UNLABELLED`` texts, those whose ids have the smallest hashes, each sample of at
most ``MAX_BYTES``;
scoring is a sparse dot product in each task.

Defined results: null, empty and white-space texts have no feature and get the score of the bias;
without a confirmed toxic text (no label, or no row of at most ``MAX_BYTES`` that it belongs to) every score is 0; repeated labels of an id count as one, the largest; a
null ``doc_id`` is in no held-out fold and is never trained on; repeated rows are scored each; an empty
table gives no rows. ``score_toxicity`` passes all other columns through and replaces one named
``score``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortscope.llm.base import held_out, query, table
from cohortscope.llm.features import (
    MAX_BYTES,
    Sparse,
    beginning_number,
    extract,
    fold_columns,
    packed,
    plain_number,
    sampled,
    scored,
)

BITS = 20
MAX_POSITIVE = 3_000
MAX_UNLABELLED = 10_000
MIN_Z = 4.0
MIN_SHARE = 0.6
MIN_TEXTS = 4
THRESHOLD = 0.3


def featurise(texts: pa.Array) -> Sparse:
    return extract(texts, BITS, [(plain_number, 1), (beginning_number, 1)])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


class Rows:
    """Texts as lists of the features that have a weight."""

    def __init__(self, parts: list[tuple], column: np.ndarray) -> None:
        sizes = np.concatenate([np.zeros(0, np.int64), *(p[0] for p in parts)])
        index = np.concatenate([np.zeros(0, np.int64), *(p[1] for p in parts)])
        rows, columns = np.repeat(np.arange(len(sizes)), sizes), column[index.astype(np.int64)]
        weighted = columns >= 0
        self.n, self.columns = len(sizes), columns[weighted]
        self.starts = np.searchsorted(rows[weighted], np.arange(self.n + 1))

    def take(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.starts[chosen + 1] - self.starts[chosen]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[chosen] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        return np.repeat(np.arange(len(chosen)), sizes), self.columns[at]


def non_negative_pu(
    positive: Rows, unlabelled: Rows, n_weights: int, prior: float, epochs: int = 80, batch: int = 2048,
    rate: float = 0.1, decay: float = 1e-4, seed: int = 0,
) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk with logistic loss, by Adam steps."""
    w = np.zeros(n_weights + 1)
    w[-1] = np.log(prior / (1.0 - prior))
    mean, square, step = np.zeros_like(w), np.zeros_like(w), 0
    shuffle, batches = np.random.default_rng(seed), max(1, unlabelled.n // batch)
    for _ in range(epochs):
        parts = zip(
            np.array_split(shuffle.permutation(positive.n), batches),
            np.array_split(shuffle.permutation(unlabelled.n), batches),
            strict=True,
        )
        for p, u in parts:
            if not len(p) or not len(u):
                continue
            (p_rows, p_cols), (u_rows, u_cols) = positive.take(p), unlabelled.take(u)
            zp = np.bincount(p_rows, w[p_cols], minlength=len(p)) + w[-1]
            zu = np.bincount(u_rows, w[u_cols], minlength=len(u)) + w[-1]
            clean_risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            du, dp = _sigmoid(zu) / len(u), -prior * _sigmoid(zp) / len(p)
            if clean_risk >= 0:
                dp = dp - prior * _sigmoid(-zp) / len(p)
            else:
                du, dp = -du, -dp
            gradient = decay * w
            gradient[-1] = du.sum() + dp.sum()
            gradient[:-1] += np.bincount(u_cols, du[u_rows], minlength=n_weights)
            gradient[:-1] += np.bincount(p_cols, dp[p_rows], minlength=n_weights)
            step += 1
            mean = 0.9 * mean + 0.1 * gradient
            square = 0.999 * square + 0.001 * gradient**2
            w -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def _texts_in(parts: list[tuple]) -> np.ndarray:
    return np.bincount(np.concatenate([np.zeros(0, np.int64), *(p[1] for p in parts)]), minlength=1 << BITS)


def train(positive: list[tuple], unlabelled: list[tuple], prior: float) -> tuple[np.ndarray, float]:
    """A weight for each hashed feature (mostly zero) and the bias."""
    n_positive, n_unlabelled = (sum(len(p[0]) for p in x) for x in (positive, unlabelled))
    in_positive, in_unlabelled = _texts_in(positive), _texts_in(unlabelled)
    expected = (in_unlabelled + 1) * (n_positive / max(1, n_unlabelled))
    clear = (in_positive - expected) / np.sqrt(expected) >= MIN_Z
    kept = clear & (prior * in_positive >= MIN_SHARE * expected) & (in_positive >= MIN_TEXTS)
    column = np.where(kept, np.cumsum(kept) - 1, -1)
    found, bias = non_negative_pu(Rows(positive, column), Rows(unlabelled, column), int(kept.sum()), prior)
    weights = np.zeros(1 << BITS)
    weights[kept] = found
    return weights, bias


def fit(
    docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED,
    max_bytes: int = MAX_BYTES,
) -> Callable[[Sparse], np.ndarray]:
    """A score function learnt from confirmed toxic rows of ``labels`` (doc_id, toxic) and from ``docs``."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    total, toxic = known.agg(F.count("*"), F.sum("toxic")).first()
    if not toxic:
        return lambda x: np.zeros(x.n)

    def sample(ids: DataFrame, rows: int) -> list[tuple]:
        chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        texts = sampled(docs, chosen, max_bytes)
        return packed(texts.dropDuplicates(["h"]), featurise, "h", counted=False)

    positive = sample(known.filter("toxic = 1").select("doc_id"), max_positive)
    if not positive:
        return lambda x: np.zeros(x.n)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    unlabelled = sample(ids.distinct(), max_unlabelled)
    weights, bias = train(positive, unlabelled, min(0.99, toxic / total))
    weights = weights.astype(np.float32)

    def score(x: Sparse) -> np.ndarray:
        return _sigmoid(np.bincount(x.rows, weights[x.index], minlength=x.n) + bias)

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) with ``score``: how likely a text is toxic."""
    return scored(docs, featurise, fit(docs, labels))


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score_toxicity(docs, table(spark, sf_dir, "labels"))
    return found.select(
        "doc_id", fold_columns(F.col("doc_id")), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
