import pytest
from pyspark.sql import functions as F

from cohortscope.operators.observed import observe_checks, require, require_not_null
from cohortscope.operators.scoring import score_resume
from cohortscope.streaming.incremental import score_new_files
from tests.conftest import rows
from tests.test_io_and_scoring import doubler


@pytest.fixture
def cases(spark):
    data = [(i, None if i % 10 == 0 else i, i % 3 == 0, "x" if i % 3 == 0 else None) for i in range(100)]
    return spark.createDataFrame(data, "id int, v int, a boolean, b string")


def report_of(df, path, **checks):
    checked, report = observe_checks(df, "checks", **checks)
    checked.write.mode("overwrite").parquet(path)
    return {(r.check, r.detail): (r.n, r.as_expected) for r in report().collect()}


def test_counts(spark, tmp_path, cases):
    got = report_of(
        cases, str(tmp_path / "out"), not_null=["id", "v"], size=100,
        implies={"a is b": (F.col("a"), F.col("b") == "x"), "a is v": (F.col("a"), F.col("v") > 50)},
        equal_counts={"same": (F.col("a"), F.col("b").isNotNull()), "more": (F.col("id") < 50, F.col("v") > 90)},
        steps=[("known", F.col("v").isNotNull()), ("a", F.col("a")), ("late", F.col("v") > 80)],
    )
    late = [i for i in range(100) if i % 10 and i % 3 == 0]
    broken = sum((i % 3 == 0) != (i % 10 != 0 and i > 50) for i in range(100))
    assert got == {
        ("not_null", "id"): (0, True), ("not_null", "v"): (10, False), ("size", "100"): (100, True),
        ("implies", "a is b"): (0, True), ("implies", "a is v"): (broken, False),
        ("equal_counts", "same"): (0, True), ("equal_counts", "more"): (50 - 9, False),
        ("step", "input"): (100, None), ("step", "known"): (90, None), ("step", "a"): (len(late), None),
        ("step", "late"): (sum(i > 80 for i in late), None),
    }
    assert spark.read.parquet(str(tmp_path / "out")).count() == 100


def test_write_and_checks_take_one_scan(spark, tmp_path, cases):
    cases.write.parquet(str(tmp_path / "in"))
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    source = spark.read.parquet(str(tmp_path / "in"))
    passed = source.mapInPandas(count, source.schema)
    got = report_of(passed, str(tmp_path / "out"), not_null=["v"], size=100, steps=[("a", F.col("a"))])
    assert got[("not_null", "v")] == (10, False) and got[("step", "a")] == (34, None)
    assert seen.value == 100
    checked, _ = observe_checks(source, "plan", not_null=["v"], size=100)
    plan = checked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "CollectMetrics" in plan


def test_empty_table_and_nothing_to_check(spark, tmp_path, cases):
    got = report_of(cases.filter("id < 0"), str(tmp_path / "out"), not_null=["v"], size=0, steps=[("a", F.col("a"))])
    assert got == {("not_null", "v"): (0, True), ("size", "0"): (0, True), ("step", "input"): (0, None), ("step", "a"): (0, None)}
    with pytest.raises(ValueError):
        observe_checks(cases, "none")


def test_strict_checks_fail_the_job(spark, tmp_path, cases):
    assert rows(require(cases, {"small": F.col("id") < 100})) == rows(cases)
    assert require_not_null(cases, ["id"]).columns == cases.columns
    for i, bad in enumerate((require_not_null(cases, ["id", "v"]), require(cases, {"v known": F.col("v") > 0}))):
        with pytest.raises(Exception, match="check failed: v"):
            bad.write.parquet(str(tmp_path / f"bad{i}"))
        assert not (tmp_path / f"bad{i}" / "_SUCCESS").exists()


def test_rows_without_a_key_are_not_scored_in_silence(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.0), (None, 2.0), (3, 3.0)], "id long, v double")
    with pytest.raises(Exception, match="id is never NULL"):
        score_resume(df, str(tmp_path / "done"), "id", doubler).collect()


def test_stream_scores_a_case_once(spark, tmp_path):
    """A case that two files hold, twice in a file, and a delivery that comes again."""
    source, done, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    df = spark.range(8).withColumn("v", F.col("id") * 1.0)
    for part in ("id < 5", "id >= 3", "id < 5"):
        some = df.filter(part)
        some.union(some).write.mode("append").parquet(source)
        assert score_new_files(spark, source, df.schema, done, state, doubler, key="id").awaitTermination(120)
    assert rows(spark.read.parquet(done), "id") == [(i,) for i in range(8)]
    spark.createDataFrame([(None, 1.0)], "id long, v double").write.mode("append").parquet(source)
    with pytest.raises(Exception, match="id is never NULL"):
        score_new_files(spark, source, df.schema, done, state, doubler, key="id").awaitTermination(120)
