import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortscope.operators.bootstrap import bootstrap_cells, bootstrap_exact, metric_ci, resample_rows
from cohortscope.operators.evaluation import (
    baseline_diagnosis_rate,
    confusion_counts,
    confusion_matrix,
    pr_curve,
    ranking_metrics,
    roc_curve,
    with_outcome,
    youden_threshold,
)
from cohortscope.functions.survival import year_labels
from cohortscope.operators.rank_tests import bonferroni, mann_whitney
from cohortscope.operators.survival import (
    censoring_distribution,
    concordance_index,
    survival_metrics,
)
from cohortscope.plans.evaluation import evaluate_cohort
from tests.conftest import rows


def brute_metrics(pairs):
    """AUROC over all pairs, AP and trapezoid area threshold by threshold."""
    pos = [s for s, y in pairs if y == 1]
    neg = [s for s, y in pairs if y == 0]
    if not pos or not neg:
        return None, None, None
    auroc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    ap = trap = 0.0
    recall0, precision0 = 0.0, 1.0
    for t in sorted({s for s, _ in pairs}, reverse=True):
        tp, fp = sum(p >= t for p in pos), sum(n >= t for n in neg)
        recall, precision = tp / len(pos), tp / (tp + fp)
        ap += (recall - recall0) * precision
        trap += (recall - recall0) * (precision + precision0) / 2
        recall0, precision0 = recall, precision
    return auroc, trap, ap


def frame(spark, pairs):
    return spark.createDataFrame([(float(s), y) for s, y in pairs], "s double, y int")


@pytest.mark.parametrize("seed,levels", [(0, 3), (1, 10), (2, 1000), (3, 1)])
def test_metrics_equal_brute_force(spark, seed, levels):
    rng = random.Random(seed)
    pairs = [(rng.randrange(levels) / levels, int(rng.random() < 0.3)) for _ in range(150)]
    got = ranking_metrics(frame(spark, pairs), "s", "y").first()
    for mine, theirs in zip((got["auroc"], got["auprc"], got["average_precision"]), brute_metrics(pairs), strict=True):
        assert mine == pytest.approx(theirs, abs=1e-12)


def test_all_tied_is_one_half(spark):
    assert ranking_metrics(frame(spark, [(0.5, 1), (0.5, 0), (0.5, 0)]), "s", "y").first()["auroc"] == 0.5


def test_reversed_score_complements(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(20), rng.randrange(2)) for _ in range(80)]
    a = ranking_metrics(frame(spark, pairs), "s", "y").first()["auroc"]
    b = ranking_metrics(frame(spark, [(-s, y) for s, y in pairs]), "s", "y").first()["auroc"]
    assert a + b == pytest.approx(1.0)


def test_missing_scores_other_labels_and_single_class(spark):
    df = spark.createDataFrame(
        [("a", 0.9, 1), ("a", 0.1, 0), ("a", None, 1), ("a", float("nan"), 0), ("a", 0.5, -1), ("b", 0.3, 1)],
        "g string, s double, y int",
    )
    got = {r["g"]: r for r in ranking_metrics(df, "s", "y", ["g"]).collect()}
    assert (got["a"]["n_pos"], got["a"]["n_neg"], got["a"]["auroc"]) == (1, 1, 1.0)
    assert got["b"]["auroc"] is None and got["b"]["auprc"] is None
    empty = ranking_metrics(df.filter("s > 5"), "s", "y").first()
    assert empty["auroc"] is None


def test_curves(spark):
    pairs = [(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0)]
    roc = sorted(map(tuple, roc_curve(frame(spark, pairs), "s", "y").collect()), reverse=True)
    assert roc == [(math.inf, 0.0, 0.0), (0.9, 0.0, 0.5), (0.8, 0.5, 1.0), (0.1, 1.0, 1.0)]
    pr = sorted(map(tuple, pr_curve(frame(spark, pairs), "s", "y").collect()), reverse=True)
    assert pr == [(math.inf, 1.0, 0.0), (0.9, 1.0, 0.5), (0.8, 2 / 3, 1.0), (0.1, 0.5, 1.0)]
    best = youden_threshold(frame(spark, pairs), "s", "y").first()
    assert (best["threshold"], best["youden"]) == (0.9, 0.5)


def test_youden_by_group(spark):
    df = spark.createDataFrame([(g, s, y) for g in "ab" for s, y in ((0.9, 1), (0.2, 0))], "g string, s double, y int")
    assert rows(youden_threshold(df, "s", "y", ["g"]), "g", "threshold") == [("a", 0.9), ("b", 0.9)]


def test_confusion(spark):
    df = frame(spark, [(0.9, 1), (0.8, 0), (0.2, 1), (0.0121, 1)])
    assert tuple(confusion_counts(df, "y", "s", 0.0121).first()) == (3, 1, 0, 0)
    assert rows(confusion_matrix(df, "y", "s", 0.5)) == [(0, 0, 0), (0, 1, 1), (1, 0, 2), (1, 1, 1)]
    assert rows(with_outcome(df, "y", "s", 0.5), "predicted", "outcome") == [(0, "FN"), (0, "FN"), (1, "FP"), (1, "TP")]


def survival_cases(seed, n=120, years=4):
    rng = random.Random(seed)
    return [
        (i, int(rng.random() < 0.4), rng.randrange(years + 1), *[rng.randrange(12) / 12 for _ in range(years)])
        for i in range(n)
    ]


SURVIVAL = "id int, event int, time int, s0 double, s1 double, s2 double, s3 double"
SCORES = ["s0", "s1", "s2", "s3"]


def test_survival_metrics_equal_brute_force(spark):
    cases = survival_cases(7)
    got = {(r["year"], r["metric"]): r["value"] for r in survival_metrics(spark.createDataFrame(cases, SURVIVAL), SCORES, "time", "event").collect()}
    for i in range(4):
        pairs = []
        for _, event, time, *scores in cases:
            if event == 1 and time <= i:
                pairs.append((scores[i], 1))
            elif time >= i:
                pairs.append((scores[i], 0))
        for metric, value in zip(("auroc", "auprc", "average_precision"), brute_metrics(pairs), strict=True):
            assert got[(i + 1, metric)] == pytest.approx(value, abs=1e-12)


def brute_km(cases):
    g, out = 1.0, {}
    for t in sorted({c[2] for c in cases}):
        at_risk = sum(c[2] >= t for c in cases)
        g *= 1 - sum(c[2] == t and c[1] == 0 for c in cases) / at_risk
        out[t] = g
    return out


def brute_c(cases, g):
    won = total = 0.0
    for a in cases:
        for b in cases:
            if a[1] == 1 and a[2] < b[2] and a[2] < 4 and g.get(a[2], 0) > 0:
                w = g[a[2]] ** -2
                p, q = a[3 + a[2]], b[3 + a[2]]
                won += w * ((p > q) + 0.5 * (p == q))
                total += w
    return won / total if total else None


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_concordance_equals_all_pairs(spark, seed):
    cases = survival_cases(seed)
    df = spark.createDataFrame(cases, SURVIVAL)
    km = {r["time"]: r["g"] for r in censoring_distribution(df, "time", "event").collect()}
    expected = brute_km(cases)
    assert km == pytest.approx(expected)
    got = concordance_index(df, SCORES, "time", "event").first()
    assert got["c_index"] == pytest.approx(brute_c(cases, expected))
    given = spark.createDataFrame([(t, 1.0 - t / 10) for t in range(5)], "time int, g double")
    got = concordance_index(df, SCORES, "time", "event", given).first()
    assert got["c_index"] == pytest.approx(brute_c(cases, {t: 1.0 - t / 10 for t in range(5)}))


def test_concordance_without_comparable_pairs(spark):
    df = spark.createDataFrame([(i, i % 2, 0, 0.1, 0.1, 0.1, 0.1) for i in range(6)], SURVIVAL)
    assert concordance_index(df, SCORES, "time", "event").first()["c_index"] is None


def test_baseline_rate(spark):
    df = spark.createDataFrame([(1, 0), (1, 3), (0, 0), (0, 5)], "event int, time int")
    labelled = df.withColumn("y", year_labels(F.col("event"), F.col("time"), 6))
    assert tuple(baseline_diagnosis_rate(labelled, "y", "event", "time").first()) == (4, 1, 25.0, True)


def test_resample_draws_n_of_n_and_repeats(spark):
    df = spark.createDataFrame([(i,) for i in range(50)], "id int")
    one = resample_rows(df, "id", 20, 42)
    assert {r["count"] for r in one.groupBy("replicate").count().collect()} == {50}
    assert rows(one) == rows(resample_rows(df.repartition(5), "id", 20, 42))
    assert rows(one) != rows(resample_rows(df, "id", 20, 43))


def test_bootstrap_skips_single_class_replicates(spark):
    df = spark.createDataFrame([(i, 0, int(i == 0), i / 10) for i in range(5)], "id int, time int, event int, s double")
    values = bootstrap_exact(df, "id", ["s"], "time", "event", 200)
    n = values.filter("metric = 'auroc'").count()
    # A given row is absent from a resample of 5 with probability 0.8 ** 5 = 0.33.
    assert 90 < n < 180
    assert values.filter("value is null").count() == 0


def test_cells_and_exact_bootstrap_agree(spark):
    rng = random.Random(9)
    cases = [(i, 0, int(rng.random() < 0.3), 0.0) for i in range(300)]
    cases = [(i, t, e, round(rng.gauss(e, 1.5), 1)) for i, t, e, _ in cases]
    df = spark.createDataFrame(cases, "id int, time int, event int, s double")
    exact = {r["metric"]: r for r in metric_ci(bootstrap_exact(df, "id", ["s"], "time", "event", 600)).collect()}
    cells = {r["metric"]: r for r in metric_ci(bootstrap_cells(df, "s", "event", 600, ranges=7), ["metric"]).collect()}
    for metric, row in exact.items():
        assert cells[metric]["mean"] == pytest.approx(row["mean"], abs=0.01)
        assert cells[metric]["lower_bound"] == pytest.approx(row["lower_bound"], abs=0.025)
        assert cells[metric]["upper_bound"] == pytest.approx(row["upper_bound"], abs=0.025)


def test_cells_bootstrap_walks_blocks_like_one_draw(spark, monkeypatch):
    """Many small blocks and ranges leave the mean at the plain AUROC, and seeds repeat."""
    import cohortscope.operators.bootstrap as bootstrap

    monkeypatch.setattr(bootstrap, "DRAWS_PER_BLOCK", 900)
    rng = random.Random(1)
    df = spark.createDataFrame([(g, rng.random() + 0.3 * y, y) for g in "ab" for y in (0, 1) for _ in range(100)], "g string, s double, y int")
    plain = {r["g"]: r["auroc"] for r in ranking_metrics(df, "s", "y", ["g"]).collect()}
    values = bootstrap_cells(df, "s", "y", 300, by=["g"], ranges=5)
    got = {r["g"]: r for r in metric_ci(values.filter("metric = 'auroc'"), ["g"]).collect()}
    for g, value in plain.items():
        assert got[g]["mean"] == pytest.approx(value, abs=0.01)
        assert got[g]["upper_bound"] - got[g]["lower_bound"] == pytest.approx(0.14, abs=0.05)
    again = bootstrap_cells(df.repartition(3), "s", "y", 300, by=["g"], ranges=5)
    assert rows(values) == rows(again)


def test_bootstrap_c_index(spark):
    df = spark.createDataFrame(survival_cases(3, n=80), SURVIVAL)
    values = bootstrap_exact(df, "id", SCORES, "time", "event", 10, with_c_index=True)
    c = values.filter("metric = 'c_index'")
    assert c.count() == 10 and c.filter("value between 0.2 and 0.8").count() == 10


def brute_mann_whitney(base, other):
    u = sum((a > b) + 0.5 * (a == b) for a in base for b in other)
    n1, n2 = len(base), len(other)
    n = n1 + n2
    _, counts = np.unique(base + other, return_counts=True)
    ties = sum(int(c) ** 3 - int(c) for c in counts)
    sd = math.sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1))))
    z = max(abs(u - n1 * n2 / 2) - 0.5, 0) / sd
    return u, z, min(math.erfc(z / math.sqrt(2)), 1.0)


def test_mann_whitney(spark):
    rng = random.Random(5)
    data = {"base": [rng.randrange(20) for _ in range(40)], "x": [rng.randrange(25) for _ in range(30)], "y": [rng.randrange(20) for _ in range(50)]}
    df = spark.createDataFrame([(d, float(v)) for d, vs in data.items() for v in vs], "d string, v double")
    tests = bonferroni(mann_whitney(df, "v", "d", "base"))
    got = {r["d"]: r for r in tests.collect()}
    assert set(got) == {"x", "y"}
    for d, row in got.items():
        u, z, p = brute_mann_whitney(data["base"], data[d])
        assert row["u"] == u and row["z"] == pytest.approx(z) and row["p_value"] == pytest.approx(p, abs=2e-7)
        assert row["adjusted_p_value"] == pytest.approx(min(2 * row["p_value"], 1.0))
        auroc = brute_metrics([(v, 1) for v in data["base"]] + [(v, 0) for v in data[d]])[0]
        assert row["u"] / (row["n_baseline"] * row["n_other"]) == pytest.approx(auroc)


def test_evaluate_cohort(spark):
    df = spark.createDataFrame(survival_cases(8), SURVIVAL)
    out = evaluate_cohort(df, "id", SCORES, "time", "event", n_replicates=30)
    assert out["metrics"].count() == 12 and out["intervals"].count() == 12
    assert out["error_bars"].filter("error_low < -0.1 or error_high < -0.1").count() == 0
    assert out["roc"].select("year").distinct().count() == 4
