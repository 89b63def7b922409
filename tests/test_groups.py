import random

import pandas as pd
from pyspark.sql import functions as F

from cohortscope.operators.groups import (
    add_timepoint,
    argmax_row_per_group,
    dedupe_keep_first,
    first_per_group,
    flag_duplicates,
    last_per_group,
    middle_element,
    minmax_scale_255,
    slice_numbers,
)
from cohortscope.operators.profiles import (
    average_ranks,
    conditional_median,
    count_or_zero,
    feature_combinations,
    five_number_summary,
    mean_ci,
    value_counts,
    with_average_rank,
)
from tests.conftest import rows


def visits(seed=0, n=300):
    """Rows of which a third belong to one subject."""
    rng = random.Random(seed)
    subjects = ["hot"] * 10 + [f"p{i}" for i in range(20)]
    return [(rng.choice(subjects), rng.randrange(9), rng.randrange(50), i) for i in range(n)]


def test_first_last_and_dedupe(spark):
    data = visits()
    df = spark.createDataFrame(data, "pid string, t int, v int, id int")
    pdf = pd.DataFrame(data, columns=["pid", "t", "v", "id"]).sort_values(["pid", "t", "v", "id"])
    first = pdf.groupby("pid").head(1)
    last = pdf.groupby("pid").tail(1)
    one = pdf.drop_duplicates(["pid", "t"], keep="first")
    order = ["t", "v", "id"]
    assert rows(first_per_group(df, ["pid"], order)) == rows(spark.createDataFrame(first))
    assert rows(last_per_group(df, ["pid"], order)) == rows(spark.createDataFrame(last))
    assert rows(dedupe_keep_first(df, ["pid", "t"], ["v"])) == rows(spark.createDataFrame(one))


def test_first_row_is_pruned_before_the_shuffle(spark):
    df = spark.createDataFrame(visits(), "pid string, t int, v int, id int")
    plan = first_per_group(df, ["pid"], ["t"])._jdf.queryExecution().executedPlan().toString()
    limit = [i for i, line in enumerate(plan.splitlines()) if "WindowGroupLimit" in line]
    exchange = [i for i, line in enumerate(plan.splitlines()) if "Exchange" in line]
    assert len(limit) == 2 and limit[0] < exchange[0] < limit[1]


def test_timepoint_counts_from_all_rows(spark):
    df = spark.createDataFrame([("a", 2001), ("a", 1999), ("b", 2005), (None, 2000)], "pid string, y int")
    assert rows(add_timepoint(df, "pid", "y"), "pid", "y", "timepoint") == [
        ("a", 1999, 0),
        ("a", 2001, 2),
        ("b", 2005, 0),
        (None, 2000, None),
    ]


def test_flag_duplicates_counts_copies(spark):
    data = [("a", 1, "x")] * 4 + [("a", 1, "y")] * 2 + [("b", 1, "x")] + [("c", 2, "z")] * 3
    df = spark.createDataFrame(data, "pid string, t int, v string")
    got = flag_duplicates(df, ["pid", "t"], ["v"])
    pdf = pd.DataFrame(data, columns=["pid", "t", "v"]).sort_values("v")
    expected = pdf[pdf.duplicated(["pid", "t"])].groupby(["pid", "t", "v"]).size().to_dict()
    assert {(r["pid"], r["t"], r["v"]): r["n_duplicates"] for r in got.filter("n_duplicates > 0").collect()} == expected
    assert got.agg(F.sum("n_copies")).first()[0] == len(data)


def test_argmax_takes_first_of_ties(spark):
    df = spark.createDataFrame([(1, 3.0, 2), (1, 5.0, 9), (1, 5.0, 4), (2, None, 1), (2, 0.0, 2)], "id int, m double, seq int")
    assert rows(argmax_row_per_group(df, "id", "m", ["seq"])) == [(1, 5.0, 4), (2, 0.0, 2)]


def test_minmax_scale(spark):
    df = spark.createDataFrame([("s", 0, -1000.0), ("s", 1, 0.0), ("s", 2, 1000.0), ("flat", 0, 7.0)], "s string, i int, v double")
    assert rows(minmax_scale_255(df, ["s"], "v"), "s", "i", "scaled") == [
        ("flat", 0, 0),
        ("s", 0, 0),
        ("s", 1, 127),
        ("s", 2, 255),
    ]


def test_slices(spark):
    data = [("even", i) for i in range(4)] + [("odd", i) for i in (10, 20, 30)] + [("one", 5)]
    df = spark.createDataFrame(data, "scan string, i int")
    assert rows(middle_element(df, "scan", "i")) == [("even", 2), ("odd", 20), ("one", 5)]
    numbered = slice_numbers(df, "scan", "i")
    assert rows(numbered.filter("scan = 'odd'"), "i", "slice_number", "file_name") == [
        (10, 1, "001.png"),
        (20, 2, "002.png"),
        (30, 3, "003.png"),
    ]


def test_counts(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), (None, 1)], "k string, t int")
    assert [tuple(r) for r in feature_combinations(df, ["k", "t"]).collect()] == [("a", 1, 2), ("b", 2, 1)]
    assert rows(count_or_zero(value_counts(df, "k"), "k", ["a", "z"])) == [("a", 2), ("z", 0)]


def test_ranks(spark):
    values = [3.0, 1.0, 1.0, 2.0, 3.0, 3.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v double")
    expected = pd.Series(values).rank()
    assert {r["id"]: r["avg_rank"] for r in with_average_rank(df, "v").collect()} == expected.to_dict()
    assert rows(average_ranks(df, "v")) == [(1.0, 2, 1.5), (2.0, 1, 3.0), (3.0, 3, 5.0)]


def test_summaries(spark):
    rng = random.Random(3)
    values = [round(rng.gauss(0, 1), 2) for _ in range(200)] + [9.0, -9.0]
    df = spark.createDataFrame([("d", v) for v in values], "d string, v double")
    got = five_number_summary(df, "v", ["d"]).first()
    s = pd.Series(values)
    q1, q3 = s.quantile(0.25), s.quantile(0.75)
    inside = s[(s >= q1 - 1.5 * (q3 - q1)) & (s <= q3 + 1.5 * (q3 - q1))]
    assert abs(got["q1"] - q1) < 1e-9 and abs(got["median"] - s.median()) < 1e-9
    assert (got["whisker_low"], got["whisker_high"]) == (inside.min(), inside.max())
    assert got["n_outliers"] == len(s) - len(inside)
    ci = mean_ci(df, "v").first()
    assert abs(ci["mean"] - s.mean()) < 1e-9 and abs(ci["lower_bound"] - s.quantile(0.025)) < 1e-9


def test_conditional_median(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 3.0), (0, 5.0), (0, None)], "event int, t double")
    assert rows(conditional_median(df, "t"), "event", "median") == [(0, 5.0), (1, 2.5)]


def test_nan_counts_as_missing(spark):
    nan = float("nan")
    df = spark.createDataFrame([("a", 1.0), ("a", nan), ("a", None), ("a", 3.0)], "g string, v double")
    assert conditional_median(df, "v", "g").first()["median"] == 2.0
    assert rows(average_ranks(df, "v"), "v", "avg_rank") == [(1.0, 1.0), (3.0, 2.0)]
    assert five_number_summary(df, "v", ["g"]).first()["n"] == 2
