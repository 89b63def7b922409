import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortscope.operators import histogram
from cohortscope.operators.histogram import box_summary, bucket_of, bucketed, selected_percentiles, values_in

FRACTIONS = {"a": 0.0, "b": 0.025, "c": 0.5, "d": 0.9, "e": 1.0}


def data(seed, n=600):
    r = random.Random(seed)
    kinds = {
        "tied": lambda: r.randrange(4) / 2,
        "wide": lambda: r.choice([-1, 1]) * 10 ** r.uniform(-300, 300),
        "narrow": lambda: 1000 + r.random() / 10**6,
        "normal": lambda: r.gauss(0, 1),
        "one": lambda: 7.0,
        "odd": lambda: r.choice([0.0, -0.0, 5e-324, -5e-324, 1e300, -1e300, 1.0]),
    }
    rows = [(g, make()) for g, make in kinds.items() for _ in range(r.randrange(1, n))]
    return rows + [("normal", None), ("normal", float("nan")), (None, 1.0), ("single", 3.5)]


def by_group(rows):
    out = {}
    for g, v in rows:
        if g is not None and v is not None and not math.isnan(v):
            out.setdefault(g, []).append(v)
    return out


@pytest.mark.parametrize("seed, max_wanted", [(0, 100_000), (1, 0)])
def test_percentiles_and_boxes_equal_numpy(spark, monkeypatch, seed, max_wanted):
    monkeypatch.setattr(histogram, "MAX_WANTED", max_wanted)
    rows = data(seed)
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    expected = by_group(rows)
    got = {r.g: r for r in selected_percentiles(df, "v", FRACTIONS, ["g"]).collect()}
    assert set(got) == set(expected)
    for g, values in expected.items():
        r, ordered = got[g], sorted(values)
        assert r.n == len(values) and r["mean"] == pytest.approx(math.fsum(values) / len(values), rel=1e-9, abs=max(map(abs, values)) * 1e-12)
        for name, fraction in FRACTIONS.items():
            position = (len(ordered) - 1) * fraction
            low, high = ordered[math.floor(position)], ordered[math.ceil(position)]
            assert r[name] == pytest.approx(low + (high - low) * (position - math.floor(position)), rel=1e-12), (g, name)
    boxes = {r.g: r for r in box_summary(df.filter("g NOT IN ('odd', 'wide')"), "v", ["g"]).collect()}
    for g, r in boxes.items():
        q1, median, q3 = np.percentile(expected[g], [25, 50, 75])
        low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        inside = [v for v in expected[g] if low <= v <= high]
        assert (r.q1, r.median, r.q3) == pytest.approx((q1, median, q3))
        assert (r.whisker_low, r.whisker_high, r.n_outliers) == (min(inside), max(inside), len(expected[g]) - len(inside)), g


def test_without_groups_and_without_rows(spark):
    df = spark.createDataFrame([(i, float(i % 10)) for i in range(101)], "g int, v double")
    assert tuple(selected_percentiles(df, "v", {"m": 0.5}).first()) == (101, pytest.approx(450 / 101), 4.0)
    assert tuple(box_summary(df, "v", []).first())[:4] == (101, 2.0, 4.0, 7.0)
    none = df.filter("g < 0")
    assert tuple(selected_percentiles(none, "v", {"m": 0.5}).first()) == (None, None, None)
    assert selected_percentiles(none, "v", {"m": 0.5}, ["g"]).count() == 0 and box_summary(none, "v", ["g"]).count() == 0


@given(st.lists(st.floats(allow_nan=False), min_size=2, max_size=30))
@settings(max_examples=15, deadline=None)
def test_buckets_never_fall(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", bucket_of(F.col("v")).alias("b"))
    found = sorted((r.v, r.b) for r in df.collect())
    assert all(a[1] <= b[1] for a, b in zip(found, found[1:], strict=False))


def test_only_buckets_that_hold_a_rank_move(spark):
    """Of two hundred thousand distinct values few are shuffled as values."""
    df = spark.range(200_000).select(F.lit("x").alias("g"), (F.rand(3) * 1000).alias("v"))
    buckets = bucketed(df, "v", ["g"])
    assert buckets.count() < 20_000
    median = buckets.filter("cum_n - n <= total_n div 2 AND cum_n > total_n div 2")
    assert 0 < values_in(df, "v", ["g"], median).count() < 2_000
    plan = values_in(df, "v", ["g"], median)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
