import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortscope.operators.prefix import (
    exact_percentiles,
    place_in_ranges,
    running_totals,
    with_row_index,
)
from tests.conftest import rows


def brute(cells, descending):
    groups = defaultdict(list)
    for g, k, v in cells:
        groups[g].append((k, v))
    out = []
    for g, members in groups.items():
        total = sum(v for _, v in members)
        cum = 0
        for k, v in sorted(members, reverse=descending):
            cum += v
            out.append((g, k, v, cum, total))
    return sorted(out)


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("ranges", [1, 2, 5, 16, 300])
def test_running_totals(spark, descending, ranges):
    rng = random.Random(ranges)
    keys = {(rng.choice("aaaaab"), rng.randrange(400)) for _ in range(500)}
    cells = [(g, float(k), rng.randrange(5)) for g, k in keys]
    df = spark.createDataFrame(cells, "g string, k double, v long")
    got = running_totals(df, "k", ["v"], ["g"], descending, ranges)
    assert sorted(tuple(r) for r in got.select("g", "k", "v", "cum_v", "total_v").collect()) == brute(cells, descending)


def test_running_totals_without_groups_and_with_one_hot_group(spark):
    cells = [("x", k, 1) for k in range(2000)] + [(f"g{i}", 5, 2) for i in range(50)]
    df = spark.createDataFrame(cells, "g string, k int, v long")
    got = running_totals(df, "k", ["v"], ["g"], ranges=8)
    assert sorted(tuple(r) for r in got.select("g", "k", "v", "cum_v", "total_v").collect()) == brute(cells, False)
    one = df.filter("g = 'x'").drop("g")
    assert rows(running_totals(one, "k", ["v"], ranges=8), "k", "cum_v") == sorted(
        [(k, k + 1) for k in range(2000)], key=lambda t: [(False, str(v)) for v in t]
    )


def test_running_totals_spread_over_ranges(spark):
    df = spark.range(5000).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    placed = place_in_ranges(df, "k", ranges=8)
    sizes = [r["count"] for r in placed.groupBy("range_id").count().collect()]
    assert len(sizes) == 8
    assert max(sizes) < 5000 * 0.6


def test_running_totals_over_structs_and_nothing(spark):
    df = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (0, "z", 4)], "x int, y string, v long")
    keyed = df.select(F.struct("x", "y").alias("k"), "v")
    got = running_totals(keyed, "k", ["v"], ranges=3).select("k.x", "k.y", "cum_v")
    assert rows(got) == [(0, "z", 4), (1, "a", 6), (1, "b", 7)]
    assert running_totals(keyed.filter("v > 99"), "k", ["v"], ranges=3).count() == 0


def test_running_totals_leaves_out_null_keys(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", None, 5), (None, 2, 7)], "g string, k int, v long")
    assert rows(running_totals(df, "k", ["v"], ["g"], ranges=4), "g", "k", "total_v") == [("a", 1, 1)]


@pytest.mark.parametrize("size", [1, 2, 3, 10, 101])
def test_exact_percentiles(spark, size):
    rng = np.random.default_rng(size)
    values = {g: np.round(rng.normal(size=size), 1) for g in "ab"}
    df = spark.createDataFrame([(g, float(v)) for g in values for v in values[g]], "g string, v double")
    fractions = {"lo": 0.025, "q1": 0.25, "med": 0.5, "hi": 0.975, "top": 1.0}
    for row in exact_percentiles(df, "v", fractions, ["g"], ranges=4).collect():
        for name, p in fractions.items():
            assert row[name] == pytest.approx(np.percentile(values[row["g"]], 100 * p))
        assert row["n"] == size


def test_row_index(spark):
    df = spark.createDataFrame([(k * 3, str(k)) for k in range(100)], "k long, t string")
    got = with_row_index(df, "k", ranges=7)
    assert {(r["k"], r["row_index"], r["n_rows"]) for r in got.collect()} == {(k * 3, k, 100) for k in range(100)}
