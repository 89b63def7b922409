import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortscope.operators import bootstrap, draws, joint_bootstrap
from cohortscope.operators.bootstrap import bootstrap_exact, metric_ci, resample_rows
from cohortscope.operators.joint_bootstrap import (
    bootstrap_joint,
    draw_totals,
    hashed_draws,
    replicate_keys,
    thresholds,
    with_completing_draws,
)
from cohortscope.operators.survival import censoring_distribution
from tests.conftest import rows

SCORES = ["s0", "s1", "s2"]
SCHEMA = "id long, time int, event int, s0 double, s1 double, s2 double"


def cases(seed, n, levels=6):
    r = random.Random(seed)
    odd = [None, float("nan")]
    return [
        (i, r.choice([0, 1, 2, 3, None] if r.random() < 0.1 else [0, 1, 2, 3]), r.choice([0, 1]), *[r.choice([*odd, *[k / levels for k in range(levels)]] if r.random() < 0.1 else [k / levels for k in range(levels)]) for _ in SCORES])
        for i in range(n)
    ]


def numbered(spark, n):
    return spark.range(n).select(F.col("id").alias("row_index"), F.lit(n).cast("long").alias("n_rows"))


def weights(spark, n, replicates, seed=42):
    """Draws of every case and replicate, put together from both kinds."""
    stored = numbered(spark, n)
    attempts, total = draw_totals(stored, n, replicates, seed)
    w = hashed_draws(np.arange(n), replicate_keys(seed, attempts), thresholds(n)).astype(int)
    for r in with_completing_draws(stored, total, n, seed).collect():
        for b in r.extra or ():
            w[r.row_index, b] += 1
    return w


@pytest.mark.parametrize("n", [1, 20, 400])
def test_draws_are_n_of_n(spark, n):
    w = weights(spark, n, 200)
    assert (w.sum(axis=0) == n).all()
    if n == 400:
        assert w.var() == pytest.approx(1 - 1 / n, abs=0.02)
        assert (w == 0).mean() == pytest.approx(np.exp(-1), abs=0.01)
        # Neither cases nor replicates go together.
        c = np.corrcoef(w)
        assert abs(c[np.triu_indices(n, 1)]).max() < 0.4
        assert len({tuple(x) for x in w.T.tolist()}) == 200


def test_a_replicate_that_exceeds_n_is_drawn_anew(spark, monkeypatch):
    monkeypatch.setattr(joint_bootstrap, "poisson_mean", lambda n: 1.0)
    attempts, total = draw_totals(numbered(spark, 50), 50, 100, 1)
    assert attempts.max() > 0 and (total <= 50).all()
    assert (weights(spark, 50, 100, 1).sum(axis=0) == 50).all()


def areas(score, pos, neg):
    """AUROC, trapezoid AUPRC and average precision of weighted rows, by definition."""
    won = sum(p * q * ((a > b) + (a == b) / 2) for a, p in zip(score, pos, strict=True) for b, q in zip(score, neg, strict=True))
    tp = fp = 0
    before, trapezoid, steps = 1.0, 0.0, 0.0
    for s in sorted(set(score), reverse=True):
        p, q = (sum(w for a, w in zip(score, x, strict=True) if a == s) for x in (pos, neg))
        tp, fp = tp + p, fp + q
        now = tp / (tp + fp) if tp + fp else 1.0
        trapezoid, steps, before = trapezoid + p * (now + before) / 2, steps + p * now, now
    return won / (sum(pos) * sum(neg)), trapezoid / sum(pos), steps / sum(pos)


def brute(data, w, g):
    out = {}
    known = lambda s: s is not None and s == s
    for b in range(w.shape[1]):
        won = pairs = 0.0
        for i in range(len(SCORES)):
            used = [(c[3 + i], c[1], c[2], w[k, b]) for k, c in enumerate(data) if known(c[3 + i]) and c[1] is not None]
            score = [u[0] for u in used]
            pos = [u[3] if u[2] == 1 and u[1] <= i else 0 for u in used]
            neg = [u[3] if u[1] >= i and not (u[2] == 1 and u[1] <= i) else 0 for u in used]
            if sum(pos) and sum(neg):
                for name, value in zip(("auroc", "auprc", "average_precision"), areas(score, pos, neg), strict=True):
                    out[b, i + 1, name] = value
            former = [u[3] if u[2] == 1 and u[1] == i else 0 for u in used]
            latter = [u[3] if u[1] > i else 0 for u in used]
            n = sum(former) * sum(latter)
            if n and g[i] > 0:
                won += areas(score, former, latter)[0] * n / g[i] ** 2
                pairs += n / g[i] ** 2
        if pairs:
            out[b, None, "c_index"] = won / pairs
    return out


@pytest.mark.parametrize("n, tied, ranges, block", [(60, 20_000, 3, 2_000_000), (90, 7, 5, 300), (25, 4, 2, 40)])
def test_replicates_equal_brute_force(spark, monkeypatch, n, tied, ranges, block):
    """Tied scores in parts, blocks that cut through ties, replicates without a class."""
    monkeypatch.setattr(joint_bootstrap, "DRAWS_PER_BLOCK", block)
    monkeypatch.setattr(joint_bootstrap, "BLOCK", 7)
    data = cases(n, n)
    df = spark.createDataFrame(data + [(None, 1, 1, 0.5, 0.5, 0.5)] * 3, SCHEMA).repartition(4)
    g = {int(r.time): r.g for r in censoring_distribution(df, "time", "event").collect()}
    expected = brute(data, weights(spark, n, 20), g)
    got = bootstrap_joint(df, "id", SCORES, "time", "event", 20, tied=tied, ranges=ranges)
    got = {(r.replicate, r.year, r.metric): r.value for r in got.collect()}
    assert set(got) == set(expected)
    for k, v in expected.items():
        assert got[k] == pytest.approx(v, abs=1e-9), k


def test_seed_alone_fixes_the_result_and_agrees_with_row_draws(spark):
    df = spark.createDataFrame(cases(3, 300, 40), SCHEMA)
    one, two = (
        bootstrap_joint(x, "id", SCORES, "time", "event", 300, seed=s, ranges=r).withColumn("value", F.round("value", 9))
        for x, s, r in ((df, 1, 4), (df.repartition(7), 1, 9))
    )
    assert rows(one) == rows(two)
    other = bootstrap_joint(df, "id", SCORES, "time", "event", 300, seed=2)
    exact = {(r.year, r.metric): r for r in metric_ci(bootstrap_exact(df, "id", SCORES, "time", "event", 300, with_c_index=True)).collect()}
    for r in metric_ci(other).collect():
        e = exact[r.year, r.metric]
        assert r["mean"] == pytest.approx(e["mean"], abs=0.015)
        assert r.lower_bound == pytest.approx(e.lower_bound, abs=0.03) and r.upper_bound == pytest.approx(e.upper_bound, abs=0.03)


def test_no_cases(spark):
    assert bootstrap_joint(spark.createDataFrame([], SCHEMA), "id", SCORES, "time", "event", 5).count() == 0


def resampled(spark, df, n, replicates):
    """Draws of every case and replicate as ``resample_rows`` makes them."""
    w = np.zeros((n, replicates), int)
    for r in resample_rows(df, "id", replicates, 42).groupBy("id", "replicate").count().collect():
        w[r.id, r.replicate] = r["count"]
    return w


@pytest.mark.parametrize("n, per_task", [(1, 8_000_000), (90, 8_000_000), (90, 400)])
def test_counts_of_draws_equal_the_rows_drawn(spark, monkeypatch, n, per_task):
    monkeypatch.setattr(draws, "COUNTS_PER_TASK", per_task)
    monkeypatch.setattr(draws, "COUNTS_PER_BATCH", 100)
    df = spark.range(n)
    w = np.zeros((n, 300), int)
    for r in draws.draw_counts(numbered(spark, n), n, 300, 42).collect():
        w[r.row_index] = draws.counts_of(pa.array([bytes(r.counts)]), 300)[0]
    assert (w == resampled(spark, df, n, 300)).all() and (w.sum(axis=0) == n).all()


def test_counts_beyond_a_byte():
    counts = [np.array([0, 255, 1]), np.array([0, 256, 70_000])]
    packed = pa.array([draws.count_bytes(c) for c in counts])
    assert (draws.counts_of(packed, 3) == counts).all() and (draws.counts_of(packed[:1], 3) == counts[:1]).all()


@pytest.mark.parametrize("n, tied, block", [(60, 20_000, 200_000), (90, 7, 300)])
def test_row_bootstrap_equals_brute_force_and_joins_no_draws_to_rows(spark, monkeypatch, n, tied, block):
    data = cases(n, n)
    df = spark.createDataFrame(data + [(None, 1, 1, 0.5, 0.5, 0.5)] * 3, SCHEMA).repartition(4)
    g = {int(r.time): r.g for r in censoring_distribution(df, "time", "event").collect()}
    expected = brute(data, resampled(spark, df, n, 20), g)
    monkeypatch.setattr(joint_bootstrap, "DRAWS_PER_BLOCK", block)
    monkeypatch.setattr(bootstrap, "resample_rows", None)
    assert bootstrap.bootstrap_exact(df, "id", SCORES, "time", "event", 2).count() > 0
    got = joint_bootstrap.bootstrap_counted(df, "id", SCORES, "time", "event", 20, with_c_index=True, ranges=3, tied=tied)
    got = {(r.replicate, r.year, r.metric): r.value for r in got.collect()}
    assert set(got) == set(expected)
    for k, v in expected.items():
        assert got[k] == pytest.approx(v, abs=1e-9), k


@pytest.mark.parametrize("n_limits", [0, 3, 5, 13])
def test_hashed_draws_count_the_limits_reached(n_limits):
    keys, index = joint_bootstrap.replicate_keys(7, np.zeros(50, int)), np.array([0, 5, 2**33 + 1, 77])
    limits = np.sort(np.random.default_rng(1).integers(0, 2**32, n_limits, dtype=np.uint32))
    low, high = (index & 0xFFFFFFFF).astype(np.uint32), (index >> 32).astype(np.uint32)
    u = joint_bootstrap.mix(joint_bootstrap.mix(low ^ joint_bootstrap.mix(high))[:, None] + keys[None, :])
    assert (hashed_draws(index, keys, limits) == (u[:, :, None] >= limits).sum(axis=2)).all()
