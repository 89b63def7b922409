import random

import pytest
from pyspark.sql import functions as F

import cohortscope.operators.joins as joins
from cohortscope.operators.projection import drop_sentinels, in_list, max_bound
from cohortscope.operators.quality import (
    check_implies,
    check_not_null,
    check_unique,
    keys_match,
    selection_funnel,
)
from cohortscope.operators.selection import ACQUISITION_TIERS, acquisition_tiers, priority_tiers, stack_datasets
from cohortscope.plans.cohort import LABELLED_COLUMNS, labelled_cohort, select_scans, thin_axial_cases
from tests.conftest import rows
from workload import base

AXIAL, SAGITTAL = "[1, 0, 0, 0, 1, 0]", "[0, 1, 0, 0, 0, -1]"
HEADER_COLUMNS = "AccessionNumber string, SliceThickness string, ConvolutionKernel string, ImageOrientationPatient string, Patient_ID string, Directory string"


def headers(seed):
    rng = random.Random(seed)
    out = []
    for i in range(400):
        pid = str(100 if rng.random() < 0.3 else rng.randrange(101, 160))
        _, thickness, kernel = rng.choice([*ACQUISITION_TIERS, (0, 5.0, "LUNG"), (0, "missing", "missing")])
        out.append(
            (
                str(i),
                str(thickness),
                kernel,
                AXIAL if rng.random() < 0.7 else SAGITTAL,
                pid,
                f"/d/{pid}/01-02-{rng.randrange(1999, 2002)}-X-{rng.randrange(99)}/{i}/000.dcm",
            )
        )
    return out


def batch_by_batch(records, timepoint):
    """The selection as a chain: each batch only for subjects that have no scan yet."""
    chosen = []
    records = sorted(records, key=lambda r: r[5])
    for batch in sorted({b for b, _, _ in ACQUISITION_TIERS}):
        have = {r[4] for r in chosen}
        for b, t, k in ACQUISITION_TIERS:
            if b == batch:
                chosen += [r for r in records if r[1] == str(t) and r[2] == k and r[3] == AXIAL and r[4] not in have]
    picked = {}
    for r in chosen:
        if timepoint == "latest" or r[4] not in picked:
            picked[r[4]] = r
    first_year = {}
    for r in records:
        year = int(r[5].split("/")[3][6:10])
        first_year[r[4]] = min(year, first_year.get(r[4], 9999))
    return {
        p: (r[0], int(r[5].split("/")[3][6:10]) - first_year[p], r[5].rsplit("/", 1)[0]) for p, r in picked.items()
    }


@pytest.mark.parametrize("timepoint", ["baseline", "latest"])
@pytest.mark.parametrize("seed", [1, 2])
def test_select_scans_equals_batch_by_batch(spark, seed, timepoint):
    records = headers(seed)
    got = select_scans(spark.createDataFrame(records, HEADER_COLUMNS), timepoint)
    assert {r["pid"]: (r["AccessionNumber"], r["timepoint"], r["Directory"]) for r in got.collect()} == batch_by_batch(records, timepoint)


def test_priority_tiers_covers_every_subject_with_a_match(spark):
    df = spark.createDataFrame(headers(5), HEADER_COLUMNS)
    marked = df.withColumn("Orientation", F.when(F.col("ImageOrientationPatient") == AXIAL, "axial"))
    tiers = acquisition_tiers(thickness="t")
    marked = marked.withColumn("t", F.col("SliceThickness").try_cast("double"))
    got = priority_tiers(marked, "Patient_ID", tiers)
    some = F.lit(False)
    for _, rule in tiers:
        some = some | F.coalesce(rule, F.lit(False))
    assert rows(got.select("Patient_ID").distinct()) == rows(marked.filter(some).select("Patient_ID").distinct())
    best = {}
    for r in got.collect():
        best.setdefault(r["Patient_ID"], set()).add(max(r["tier"], 2))
    assert all(len(v) == 1 for v in best.values())


def test_include_is_a_last_resort(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "pid string, v int")
    got = priority_tiers(df, "pid", [(1, F.col("v") == 1)], include=F.col("v").isin(1, 2))
    assert rows(got) == [("a", 1, 1), ("b", 2, 2)]


def test_labelled_cohort(spark):
    scans = [
        ("1", "2.5", "STANDARD", AXIAL, "7", "/d/7/01-02-1999-A/x/0.dcm"),
        ("2", "2.5", "STANDARD", AXIAL, "7", "/d/7/01-02-2000-A/x/0.dcm"),
        ("3", "2.0", "B30f", AXIAL, "8", "/d/8/01-02-1999-A/x/0.dcm"),
    ]
    clinical = spark.createDataFrame(
        [(7, 5, None, None, 400, 3000), (8, 10, 20, 30, None, 800)],
        "pid long, scr_days0 int, scr_days1 int, scr_days2 int, candx_days int, fup_days int",
    )
    df = spark.createDataFrame(scans, HEADER_COLUMNS)
    got = labelled_cohort(df, clinical, "latest", max_followup=6)
    assert got.columns == LABELLED_COLUMNS
    assert rows(got, "pid", "event", "years_to_event", "timepoint") == [(7, 1, 0, 1), (8, 0, 2, 0)]


def test_thin_axial(spark):
    data = [
        ("a", "2020-01-01", "2.0", "B", "axial"),
        ("a", "2020-01-01", "10.0", "B", "axial"),
        ("a", "2020-01-01", "1.0", "None", "axial"),
        ("a", "2021-01-01", "1", "C", "coronal"),
        ("b", "2020-01-01", "missing", "C", "axial"),
        ("b", "2020-01-01", "3.0", "C", "axial"),
    ]
    df = spark.createDataFrame(data, "pid string, timepoint string, SliceThickness string, ConvolutionKernel string, Orientation string")
    assert rows(thin_axial_cases(df), "pid", "SliceThickness") == [("a", "2.0"), ("b", "3.0")]


@pytest.mark.parametrize("direct, gram", [(64, 4), (0, 2), (12, 3)])
def test_resolve_by_suffix_equals_testing_every_pair(spark, direct, gram):
    """All pairs of a key at once, all by the index of grams, and some either way."""
    rng = random.Random(11)

    def word(n):
        return "".join(rng.choice("12-") for _ in range(n))

    folders = [(rng.choice("ppq"), word(7), word(6), f"/f/{i:03d}") for i in range(60)]
    cases = [(i, rng.choice("ppqz"), word(rng.randrange(1, 4)), word(rng.randrange(1, 4))) for i in range(40)]
    cases += [(99, "p", None, "1"), (100, "p", "", "1"), (101, "q", "1", ""), (102, "q", "1" * 9, "2")]
    folders += [("q", "1", "", "/f/short"), ("p", None, "1", "/f/none")]
    got = joins.resolve_by_suffix(
        spark.createDataFrame(cases, "id int, pid string, t string, s string"),
        spark.createDataFrame(folders, "pid string, study string, series string, path string"),
        "pid",
        ("t", "study"),
        ("s", "series"),
        direct=direct,
        gram=gram,
    )
    expected = []
    for i, pid, t, s in cases:
        found = [f[3] for f in folders if f[0] == pid and t is not None and f[1] is not None and t in f[1] and s in f[2]]
        expected.append((i, min(found, default=None), len(found), ["none", "unique", "multiple"][min(len(found), 2)]))
    assert rows(got, "id", "resolved_path", "n_matches", "match_status") == sorted(expected, key=lambda t: [(v is None, str(v)) for v in t])


def test_a_hot_key_is_looked_up_in_an_index(spark):
    """Ten thousand folders and a thousand cases of one subject: rows grow with names and hits, not with the pairs."""
    folders = spark.range(10_000).select(F.lit("p").alias("pid"), F.format_string("study-%04d", F.col("id") % 2000).alias("study"), F.format_string("series-%05d", "id").alias("series"), F.format_string("/f/%05d", "id").alias("path"))
    cases = spark.range(1000).select("id", F.lit("p").alias("pid"), F.format_string("%04d", "id").alias("t"), F.format_string("%05d", "id").alias("s"))
    got = joins.resolve_by_suffix(cases, folders, "pid", ("t", "study"), ("s", "series"))
    assert got.filter("n_matches = 1 AND resolved_path = concat('/f/', s)").count() == 1000
    grams = joins._look_up(
        folders.toDF("_key", "_outer_name", "_inner_name", "_path"), cases.toDF("id", "_key", "_outer", "_inner").drop("id"), 4
    )
    rows_made = [
        m for m in grams._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Generate inline" in m
    ]
    assert rows_made
    index = folders.select(F.lit(4).alias("_outer_size"), F.lit(4).alias("_inner_size"), F.col("study").alias("o"), F.col("series").alias("i"))
    index = index.select("o", "i", F.size(joins._sided_grams("o", "i")).alias("n"))
    assert index.filter("n > length(o) + length(i)").count() == 0


def test_resolve_by_accession(spark):
    catalog = spark.createDataFrame([("p", "1", "/b"), ("p", "1", "/a"), ("q", "1", "/c")], "pid string, acc string, path string")
    cases = spark.createDataFrame([("p", "1"), ("p", "2"), ("q", "1")], "pid string, acc string")
    got = joins.resolve_by_accession(cases, catalog, ["pid", "acc"])
    assert rows(got) == [("p", "1", "/a"), ("p", "2", None), ("q", "1", "/c")]


def test_anti_join_ignores_null_keys(spark):
    a = spark.createDataFrame([("x",), ("y",), (None,)], "k string")
    b = spark.createDataFrame([("x",), (None,)], "k string")
    assert rows(joins.anti_by_key(a, b, "k")) == [("y",), (None,)]
    assert rows(joins.semi_by_key(a, b, "k")) == [("x",)]


def test_join_ci_and_suffixes(spark):
    a = spark.createDataFrame([("LUNG-1", 1), ("lung-2", 2)], "pid string, v int")
    b = spark.createDataFrame([("Lung-1", 10), ("LUNG-1", 11), ("x", 12)], "pid string, v2 int")
    assert rows(joins.join_ci(a, b, "pid", "pid")) == [("LUNG-1", 1, 10), ("LUNG-1", 1, 11)]
    c = spark.createDataFrame([("LUNG-1", 5)], "pid string, v int")
    assert rows(joins.join_suffixed(a, c, "pid"), "pid", "v_x", "v_y") == [("LUNG-1", 1, 5), ("lung-2", 2, None)]


def test_filters(spark):
    df = spark.createDataFrame([("1.0", 1.0), ("missing", 2.0), ("None", 3.0), ("4", None), (None, 9.0)], "t string, d double")
    assert rows(drop_sentinels(df, ["t", "d"], ["missing", "None"])) == [("1.0", 1.0)]
    assert rows(max_bound(df, "t", 3)) == [("1.0", 1.0)]
    assert in_list(df, "d", [1.0, 3.0]).count() == 2
    assert in_list(df, "d", [float(i) for i in range(2000)]).count() == 4


def test_stack_datasets(spark):
    a = spark.createDataFrame([(1, "x")], "v int, only_a string")
    b = spark.createDataFrame([(2,)], "v int")
    assert rows(stack_datasets({"A": a, "B": b}), "dataset_name", "v", "only_a") == [("A", 1, "x"), ("B", 2, None)]


def test_quality(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 1, 2), ("b", None, 3)], "pid string, c int, d int")
    assert rows(check_unique(df, ["pid"])) == [("a", 2)]
    assert tuple(check_implies(df, F.col("c") == 1, F.col("d").isNotNull()).first()) == (2, 2, 1, 1)
    with pytest.raises(ValueError, match="c, d"):
        check_not_null(df, ["c", "d", "pid"], strict=True)
    check_not_null(df, ["pid"], strict=True)
    other = spark.createDataFrame([("b",), ("z",)], "pid string")
    assert rows(keys_match(df, other, "pid")) == [("a", "a"), ("z", "b")]


def test_funnel(spark):
    data = [("a", 1, 1), ("a", 5, 1), ("b", 1, 9), ("c", 7, None), ("c", 2, None)]
    df = spark.createDataFrame(data, "pid string, x int, y int")
    steps = [("x", F.col("x") <= 3), ("y", F.col("y") == 1)]
    got = selection_funnel(df, "pid", steps).orderBy("step").collect()
    assert [tuple(r) for r in got] == [(0, "input", 5, 3), (1, "x", 3, 3), (2, "y", 1, 1)]


def exchanges(df):
    """Shuffles in the plan of a frame that was not run yet."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_folders_are_shuffled_once_where_no_key_has_many_cases(spark):
    folders = spark.createDataFrame([("p", "st-1", "se-1", "/f/1"), ("p", "st-1", "se-12", None)], "pid string, study string, series string, path string")
    cases = spark.createDataFrame([(i, "p", "1", str(i)) for i in range(4)] + [(9, None, "1", "1")] * 3, "id int, pid string, t string, s string")
    few, many = (joins.resolve_by_suffix(cases, folders, "pid", ("t", "study"), ("s", "series"), direct=d) for d in (4, 3))
    assert rows(few) == rows(many)
    assert rows(few, "id", "n_matches")[:3] == [(0, 0), (1, 2), (2, 1)]
    scanned = [p._jdf.queryExecution().optimizedPlan().toString().count("_outer_name") for p in (few, many)]
    assert scanned[0] < scanned[1] / 2


def test_folders_hold_their_scans_once_without_another_shuffle(spark, tmp_path):
    """Beside the two sides of the join by order there is no shuffle, and the rows are those of a plain distinct."""
    lines = [(o, n, 10 * n, 3, p) for o in range(20) for n in (1, 2) for p in (1.5, 1.5, 2.5, None)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double").withColumns(
        {"l_quantity": F.lit(1.0), "l_returnflag": F.lit("A"), "l_linestatus": F.lit("O")}
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = "SELECT id AS o_orderkey, id % 7 AS o_custkey, TIMESTAMP_NTZ '1996-03-04 00:00:00' AS o_orderdate FROM range(20)"
    spark.sql(orders).write.parquet(f"{tmp_path}/orders.parquet")
    parts = F.split("path", "/")
    plain = base.scans(spark, str(tmp_path)).select(
        "pid", F.get(parts, F.lit(3)).alias("study"), F.get(parts, F.lit(4)).alias("series"), F.regexp_replace("path", "/[^/]*$", "").alias("path")
    )
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = base.folders(spark, str(tmp_path))
        assert exchanges(got) == 2 < exchanges(plain.distinct())
        assert rows(got) == rows(plain.filter("path IS NOT NULL").distinct()) and got.count() == 40
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
