import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from cohortscope.functions.dates import parse_date_any
from cohortscope.functions.normal import erfc, two_sided_p
from cohortscope.functions.outcomes import classify_at, flag_if, flip_index, normalize_label, outcome_label
from cohortscope.functions.paths import (
    join_path,
    parent_dir,
    path_suffixes,
    rewrite_prefix,
    year_from_path,
    zero_pad_path,
)
from cohortscope.functions.survival import (
    days_or_approx,
    event_within,
    floor_years,
    lookup_by_timepoint,
    year_labels,
    years_to_event,
)
from cohortscope.functions.vectors import columns_with_prefix, ct_orientation, parse_vector


def apply(spark, values, schema, *columns):
    df = spark.createDataFrame([v if isinstance(v, tuple) else (v,) for v in values], schema)
    return [tuple(r) for r in df.select(*columns).collect()]


def test_orientation(spark):
    cases = {
        "[1, 0, 0, 0, 1, 0]": "axial",
        "(0.98, 0.1, 0, -0.1, 0.99, 0)": "axial",
        "[0, 1, 0, 0, 0, -1]": "sagittal",
        "[1, 0, 0, 0, 0, -1]": "coronal",
        "[0.5, 0, 0, 0, 1, 0]": "unknown",
        "[1.5, 0, 0, 0, 1, 0]": "unknown",
        "[-1, 0, 0, 0, 1, 0]": "unknown",
        "missing": "missing",
        "[1, 0]": "unknown",
        "garbage": "unknown",
        None: "missing",
    }
    got = apply(spark, list(cases), "t string", ct_orientation(F.col("t")))
    assert [g[0] for g in got] == list(cases.values())


def test_orientation_rounds_half_to_even(spark):
    # 0.5 rounds to 0 and 1.5 to 2, so neither is a unit axis; 0.51 is.
    got = apply(spark, ["[0.51, 0, 0, 0, 0.51, 0]", "[0.5, 0, 0, 0, 0.5, 0]"], "t string", ct_orientation(F.col("t")))
    assert got == [("axial",), ("unknown",)]


def test_parse_vector(spark):
    got = apply(spark, ["(0.7, 0.7, 1.0)", "[]", "[1, x]", None], "t string", parse_vector(F.col("t")))
    assert got == [([0.7, 0.7, 1.0],), (None,), (None,), (None,)]


def test_columns_with_prefix_sorts_by_number(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "feature_10 int, feature_2 int, feature_x int, pid int")
    assert columns_with_prefix(df, "feature_") == ["feature_2", "feature_10"]


def test_paths(spark):
    path = "/root/100/01-02-1999-NA-X-07029/3.000000-1OPA-97837/000.dcm"
    got = apply(
        spark,
        [path],
        "p string",
        year_from_path(F.col("p")),
        parent_dir(F.col("p")),
        *path_suffixes(parent_dir(F.col("p"))),
        rewrite_prefix(F.col("p"), "/root/", "/new.root/"),
    )[0]
    assert got[0] == 1999
    assert got[1] == path.rsplit("/", 1)[0]
    assert got[2:4] == ("07029", "97837")
    assert got[4] == path.replace("/root/", "/new.root/")


def test_paths_without_matches(spark):
    got = apply(spark, ["no/date/here", "//a///b-1/"], "p string", year_from_path(F.col("p")), *path_suffixes(F.col("p")))
    assert got == [(None, "date", "here"), (None, "a", "1")]


def test_join_and_pad_paths(spark):
    got = apply(spark, ["./a/b", "/a/b", "a/b"], "p string", join_path("/workspace/", F.col("p")))
    assert {g[0] for g in got} == {"/workspace/a/b"}
    got = apply(spark, [7, 12345], "n int", zero_pad_path("/base", "case-", F.col("n"), ".raw"))
    assert got == [("/base/case-0007.raw",), ("/base/case-12345.raw",)]


def test_dates(spark):
    got = apply(spark, ["2020-12-13", "3/4/19", "07-26-2007", "soon", None], "d string", parse_date_any(F.col("d")))
    assert [g[0] for g in got] == [dt.date(2020, 12, 13), dt.date(2019, 3, 4), dt.date(2007, 7, 26), None, None]


def test_lookup_out_of_range(spark):
    columns = [F.lit(10), F.lit(20), F.lit(None).cast("int")]
    got = apply(spark, [0, 1, 2, 3, -1, None], "t int", lookup_by_timepoint(columns, F.col("t")))
    assert [g[0] for g in got] == [10, 20, None, None, None, None]
    got = apply(spark, [(None, 2), (5, 2)], "d int, t int", days_or_approx(F.col("d"), F.col("t")))
    assert [g[0] for g in got] == [730, 5]
    got = apply(spark, [(None, 2)], "d int, t int", days_or_approx(F.col("d"), F.col("t"), 36))
    assert got == [(72,)]


def test_floor_years_of_negative_days(spark):
    got = apply(spark, [-10, 0, 364, 365, -366, None], "d int", floor_years(F.col("d")))
    assert [g[0] for g in got] == [-1, 0, 0, 1, -2, None]


def test_event_and_time(spark):
    cases = [(2, 9), (6, 9), (None, 3), (None, 9), (None, None), (-1, 4)]
    event = event_within(F.col("dx"), 6)
    got = apply(
        spark, cases, "dx int, fup int", event, years_to_event(event, F.col("dx"), F.col("fup"), 6)
    )
    assert got == [(1, 2), (0, 5), (0, 3), (0, 5), (0, None), (1, -1)]


def test_year_labels(spark):
    cases = [(1, 0.0), (1, 2.7), (1, 9.0), (0, 0.0), (1, -3.0), (1, None)]
    got = apply(spark, cases, "e int, t double", year_labels(F.col("e"), F.col("t"), 4))
    assert [g[0] for g in got] == [
        [1, 1, 1, 1],
        [0, 0, 1, 1],
        [0, 0, 0, 0],
        [0, 0, 0, 0],
        [1, 1, 1, 1],
        [0, 0, 0, 0],
    ]


def test_outcomes(spark):
    cases = [(1, 0.5), (0, 0.5), (1, 0.1), (0, 0.1), (1, None), (-1, 0.5)]
    got = apply(
        spark, cases, "e int, s double", outcome_label(F.col("e"), F.col("s"), 0.5), classify_at(F.col("s"), 0.5)
    )
    assert got == [("TP", 1), ("FP", 1), ("FN", 0), ("TN", 0), (None, None), (None, 1)]


def test_flags_and_labels(spark):
    got = apply(spark, [("nod", 4), ("nod", None), ("non", 5)], "k string, m int", flag_if((F.col("k") == "nod") & (F.col("m") > 3)))
    assert got == [(1,), (0,), (0,)]
    got = apply(spark, ["Primary lung cancer ", " Benign"], "t string", normalize_label(F.col("t")))
    assert got == [("primary lung cancer",), ("benign",)]
    assert apply(spark, [(120, 30)], "n int, p int", flip_index(F.col("n"), F.col("p"))) == [(90,)]


@pytest.mark.parametrize("x", [0.0, 0.1, 0.5, 1.0, 2.0, 3.5])
def test_erfc(spark, x):
    got = apply(spark, [x], "x double", erfc(F.col("x")), two_sided_p(F.col("x")))[0]
    assert got[0] == pytest.approx(math.erfc(x), abs=1.5e-7)
    assert got[1] == pytest.approx(math.erfc(x / math.sqrt(2)), abs=1.5e-7)
