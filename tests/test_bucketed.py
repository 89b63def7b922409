from uuid import uuid4

import pytest
from pyspark.sql import functions as F

import cohortscope.sources.bucketed as bucketed
from cohortscope.plans.cohort import labelled_cohort, labelled_cohort_of_tables
from cohortscope.sources.bucketed import bucketing, co_located, write_bucketed
from tests.conftest import rows
from tests.test_plans import executed, settings  # noqa: F401
from tests.test_selection_and_joins import HEADER_COLUMNS, headers

CLINICAL = "pid long, scr_days0 long, scr_days1 long, scr_days2 long, candx_days long, fup_days long"


@pytest.fixture
def stored(spark, tmp_path):
    """Writes both tables and returns their names and frames."""
    made = []

    def write(n_headers=8, n_clinical=8):
        cases = spark.createDataFrame(headers(3), HEADER_COLUMNS).withColumn("Patient_ID", F.col("Patient_ID").cast("long"))
        subjects = spark.createDataFrame(
            [(p, 0, 365, None, 500 if p % 3 else None, 2000) for p in range(100, 155)], CLINICAL
        )
        names = [f"t_{uuid4().hex}" for _ in range(2)]
        made.extend(names)
        write_bucketed(cases, names[0], "Patient_ID", n_headers, str(tmp_path / names[0]))
        write_bucketed(subjects, names[1], "pid", n_clinical, str(tmp_path / names[1]))
        return names, cases, subjects

    yield write
    for name in made:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


@pytest.mark.parametrize("timepoint", ["baseline", "latest"])
def test_bucketed_tables_are_selected_and_joined_without_a_shuffle(spark, stored, settings, timepoint):  # noqa: F811
    settings(autoBroadcastJoinThreshold="-1", adaptive__autoBroadcastJoinThreshold="-1")
    names, cases, subjects = stored()
    got = labelled_cohort_of_tables(spark, *names, timepoint=timepoint, max_followup=6)
    plan = executed(got)
    assert "Exchange" not in plan and "SortMergeJoin" in plan and "Window" in plan
    plain = labelled_cohort(cases, subjects, timepoint, max_followup=6)
    assert rows(got) == rows(plain) and "Exchange" in executed(plain)


def test_tables_that_do_not_fit_take_the_ordinary_way(spark, stored, settings, monkeypatch):  # noqa: F811
    settings(autoBroadcastJoinThreshold="-1", adaptive__autoBroadcastJoinThreshold="-1")
    names, cases, subjects = stored(8, 4)
    assert not co_located(spark, names[0], "Patient_ID", names[1], "pid")
    want = rows(labelled_cohort(cases, subjects, max_followup=6))
    assert rows(labelled_cohort_of_tables(spark, *names, max_followup=6)) == want
    names, _, _ = stored()
    assert bucketing(spark, names[0])[:2] == (8, "Patient_ID") and bucketing(spark, names[0])[2] > 80
    assert co_located(spark, names[0], "Patient_ID", names[1], "pid")
    assert not co_located(spark, names[0], "AccessionNumber", names[1], "pid")
    # A subject beyond the bound isn't given to one task, neither when written nor when joined.
    monkeypatch.setattr(bucketed, "MAX_KEY_ROWS", 50)
    names, _, _ = stored()
    assert not co_located(spark, names[0], "Patient_ID", names[1], "pid")
    assert rows(labelled_cohort_of_tables(spark, *names, max_followup=6)) == want


def test_empty_and_unbucketed_tables(spark, stored, tmp_path):
    names, cases, _ = stored()
    spark.sql(f"DROP TABLE {names[1]}")
    write_bucketed(spark.createDataFrame([], CLINICAL), names[1], "pid", 8, str(tmp_path / "none"))
    got = labelled_cohort_of_tables(spark, *names, max_followup=6)
    assert got.count() > 0 and got.filter("years_from_scan_to_last_followup IS NOT NULL").count() == 0
    cases.limit(3).createOrReplaceTempView("plain_cases")
    cases.limit(3).write.mode("overwrite").option("path", str(tmp_path / "p")).saveAsTable(names[0])
    assert bucketing(spark, names[0]) is None
