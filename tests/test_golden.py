"""Known answers: small inputs whose results are worked out by hand, and the guarantees of resampling."""

import pytest
from pyspark.sql import functions as F

from cohortscope.operators.bootstrap import bootstrap_cells, bootstrap_exact
from cohortscope.operators.evaluation import confusion_counts, ranking_metrics
from cohortscope.operators.groups import mark_duplicates, middle_element, slice_numbers
from cohortscope.operators.projection import in_list, max_bound
from cohortscope.operators.scoring import score_resume
from cohortscope.operators.survival import concordance_index
from cohortscope.plans.evaluation import bootstrap_intervals
from cohortscope.sources.sinks import write_by_label
from tests.conftest import rows


def test_ranking_metrics_by_hand(spark):
    # Scores 4 > 3 = 3 > 2 > 1 with labels 1, 1, 0, 0, 1: pairs won 3.5 of 6.
    df = spark.createDataFrame([(4.0, 1), (3.0, 1), (3.0, 0), (2.0, 0), (1.0, 1)], "s double, y int")
    got = ranking_metrics(df, "s", "y").first()
    assert got.auroc == pytest.approx(3.5 / 6)
    assert got.average_precision == pytest.approx((1 + 2 / 3 + 3 / 5) / 3)
    assert got.auprc == pytest.approx(((1 + 1) / 2 + (1 + 2 / 3) / 2 + (1 / 2 + 3 / 5) / 2) / 3)


def test_confusion_by_hand(spark):
    df = spark.createDataFrame([(0.9, 1), (0.5, 0), (0.5, 1), (0.1, 1), (0.2, 0)], "s double, y int")
    got = confusion_counts(df, "y", "s", 0.5).first()
    assert [got[c] for c in ("tp", "fp", "fn", "tn")] == [2, 1, 1, 1]


def cohort(spark, n=60, nulls=0):
    data = [(i, (i * 37 % 101) / 101.0, i % 3 == 0, i % 2) for i in range(n)]
    data += [(None, 0.5, True, 0) for _ in range(nulls)]
    return spark.createDataFrame(data, "id long, s double, e boolean, time int").withColumn("event", F.col("e").cast("int"))


def test_seed_fixes_the_result_whatever_the_number_of_partitions(spark):
    results, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    for partitions in ("3", "17"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        cells = bootstrap_cells(cohort(spark), "s", "event", 20)
        exact = bootstrap_exact(cohort(spark), "id", ["s"], "time", "event", 20)
        results.append((rows(cells.withColumn("value", F.round("value", 9))), rows(exact.withColumn("value", F.round("value", 9)))))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]


def test_rows_without_a_key_are_neither_drawn_nor_counted(spark):
    with_nulls = bootstrap_exact(cohort(spark, nulls=20), "id", ["s"], "time", "event", 10)
    without = bootstrap_exact(cohort(spark), "id", ["s"], "time", "event", 10)
    assert rows(with_nulls) == rows(without)


def test_intervals_of_the_c_index(spark):
    for method in ("exact", "cells"):
        got = bootstrap_intervals(cohort(spark), "id", ["s"], "time", "event", 15, method=method, with_c_index=True)
        c = got.filter("metric = 'c_index'").first()
        assert c.year is None and c.lower_bound <= c["mean"] <= c.upper_bound
        got = bootstrap_intervals(cohort(spark), "id", ["s"], "time", "event", 15, method=method)
        assert got.filter("metric = 'c_index'").count() == 0 and got.count() == 3
    with pytest.raises(ValueError):
        bootstrap_intervals(cohort(spark), "id", ["s"], "time", "event", method="other")


def test_missing_censoring_weight_is_an_error(spark):
    g = spark.createDataFrame([(7.0, 1.0)], "time double, g double")
    with pytest.raises(Exception, match="no censoring weight"):
        concordance_index(cohort(spark), ["s"], "time", "event", g).collect()


def test_slices_without_place_or_scan_stay(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 1.0), ("a", None), (None, 3.0)], "scan string, z double")
    assert rows(slice_numbers(df, "scan", "z"), "scan", "z", "slice_number") == [
        ("a", 1.0, 1), ("a", 2.0, 2), ("a", None, None), (None, 3.0, None)
    ]
    assert rows(middle_element(df, "scan", "z")) == [("a", 2.0)]


def test_mark_duplicates_keeps_every_row(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (None, "x"), (None, "z")], "k int, v string")
    assert rows(mark_duplicates(df, ["k"])) == [
        (1, "x", True), (1, "y", True), (2, "x", False), (None, "x", True), (None, "z", True)
    ]


def test_bounds_and_lists(spark):
    df = spark.createDataFrame([(1, "2"), (5, "x"), (None, None)], "n int, t string")
    assert max_bound(df, "n", 3).count() == 1 and max_bound(df, "t", 3).count() == 1
    wanted = spark.createDataFrame([(5,)], "other int")
    assert rows(in_list(df, "n", wanted), "n") == rows(in_list(df, "n", [5]), "n") == [(5,)]


def test_interrupted_output_is_written_again(spark, tmp_path):
    df = spark.createDataFrame([(1, "TP"), (2, "FN")], "id int, outcome string")
    path = tmp_path / "out"
    (path / "outcome=TP").mkdir(parents=True)
    write_by_label(df, str(path))
    assert spark.read.parquet(str(path)).count() == 2
    write_by_label(df.limit(0), str(path))
    assert spark.read.parquet(str(path)).count() == 2


def test_resume_with_features_returns_only_what_was_asked(spark, tmp_path):
    def model():
        return lambda batch: (batch[["x"]].to_numpy() * 0.5, batch[["x", "x"]].to_numpy())

    done = str(tmp_path / "scored")
    everything = spark.createDataFrame([(i, float(i)) for i in range(10)], "id long, x double")
    score_resume(everything.filter("id < 6"), done, "id", model, years=1, features=True)
    got = score_resume(everything.filter("id > 3"), done, "id", model, years=1, n_chunks=3, features=True)
    assert rows(got.select("id", "pred_risk_year_0", F.size("features"))) == [(i, i / 2, 2) for i in range(4, 10)]
    assert spark.read.parquet(done).count() == 10
