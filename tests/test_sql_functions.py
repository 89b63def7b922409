import random

import pytest
from pyspark.sql import functions as F

from cohortscope.operators.evaluation import confusion_counts, ranking_metrics, roc_curve, youden_threshold
from cohortscope.operators.profiles import mean_ci
from cohortscope.operators.rank_tests import mann_whitney
from cohortscope.operators.survival import censoring_distribution, concordance_index, survival_metrics
from cohortscope.plans.sql_functions import create_dataset_functions, create_ranking_functions, create_survival_functions
from tests.conftest import rows

SCORES = ["s 0", "s 1", "s 2"]


@pytest.fixture(scope="module")
def cases(spark):
    r = random.Random(4)
    data = [
        (i, r.choice("ab"), r.choice([0, 1, 1, None, 2]), r.randrange(4), r.randrange(2), *[r.choice([None, float("nan"), *[k / 9 for k in range(9)]]) for _ in SCORES])
        for i in range(400)
    ]
    data += [(1000 + i, "only", 1, 2, 1, 0.5, 0.5, 0.5) for i in range(3)] + [(2000, None, 1, 1, 1, 0.1, 0.2, 0.3)]
    schema = "id int, `the arm` string, `a label` int, time int, event int, `s 0` double, `s 1` double, `s 2` double"
    df = spark.createDataFrame(data, schema)
    df.createOrReplaceTempView("sql_cases")
    return df


def close(got, expected):
    got, expected = ([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows(x)] for x in (got, expected))
    assert got == expected and got


def test_ranking_functions_equal_the_operators(spark, cases):
    known = cases.filter("`the arm` IS NOT NULL")
    for by, name in (([], "whole"), (["the arm"], "by_arm")):
        made = create_ranking_functions(spark, name, "sql_cases", "s 0", "a label", by, ranges=5)
        assert made == [f"{name}_{f}" for f in ("auroc", "roc_curve", "confusion", "youden")]
        df = known if by else cases
        close(spark.sql(f"SELECT * FROM {name}_auroc()"), ranking_metrics(df, "s 0", "a label", by))
        close(spark.sql(f"SELECT * FROM {name}_roc_curve()").dropna(), roc_curve(df, "s 0", "a label", by).dropna())
        counted = confusion_counts(cases.filter("`s 0` IS NULL OR NOT isnan(`s 0`)"), "a label", "s 0", 0.4, by)
        close(spark.sql(f"SELECT * FROM {name}_confusion(0.4)"), counted.select(*by, "tp", "fp", "fn", "tn"))
        best = youden_threshold(df, "s 0", "a label", by).filter("youden IS NOT NULL")
        close(spark.sql(f"SELECT * FROM {name}_youden()"), best.select(*by, "threshold", "fpr", "tpr", "youden"))


def test_survival_functions_equal_the_operators(spark, cases):
    create_survival_functions(spark, "surv", "sql_cases", SCORES, "time", "event", ranges=4)
    close(spark.sql("SELECT * FROM surv_censoring_distribution()"), censoring_distribution(cases, "time", "event"))
    close(spark.sql("SELECT * FROM surv_concordance_index()"), concordance_index(cases, SCORES, "time", "event"))
    yearly = spark.sql("SELECT year, auroc, auprc, average_precision FROM surv_yearly_auroc()")
    tidy = yearly.unpivot("year", ["auroc", "auprc", "average_precision"], "metric", "value")
    close(tidy, survival_metrics(cases, SCORES, "time", "event"))


def test_dataset_functions_equal_the_operators(spark, cases):
    create_dataset_functions(spark, "data", "sql_cases", "s 1", "the arm", ranges=3)
    for baseline in ("a", "only"):
        close(spark.sql(f"SELECT * FROM data_mann_whitney('{baseline}')"), mann_whitney(cases, "s 1", "the arm", baseline))
    mine = spark.sql("SELECT `the arm`, mean, lower_bound, upper_bound FROM data_mean_ci(upper => 0.9)")
    close(mine, mean_ci(cases, "s 1", ["the arm"], upper=0.9))
    counted = spark.sql("SELECT cutoffs.c, m.n FROM VALUES (0.1D), (0.2D) AS cutoffs(c), LATERAL data_mean_ci(c, 0.9D) AS m WHERE `the arm` = 'a'")
    assert {r.c for r in counted.collect()} == {0.1, 0.2}


def test_functions_follow_the_relation_and_empty_ones(spark, cases):
    spark.createDataFrame([], cases.schema).createOrReplaceTempView("sql_none")
    create_ranking_functions(spark, "none", "sql_none", "s 0", "a label", ["the arm"])
    create_survival_functions(spark, "none", "sql_none", SCORES, "time", "event")
    create_dataset_functions(spark, "none", "sql_none", "s 0", "the arm")
    for call in ("auroc()", "roc_curve()", "confusion(0.1)", "youden()", "censoring_distribution()", "yearly_auroc()", "mann_whitney('a')", "mean_ci()"):
        assert spark.sql(f"SELECT * FROM none_{call}").count() == 0
    assert spark.sql("SELECT c_index FROM none_concordance_index()").first()[0] is None
    with pytest.raises(ValueError):
        create_dataset_functions(spark, "no; name", "sql_none", "s 0", "the arm")


def test_plans_stay_in_the_engine_and_prune(spark, tmp_path, cases):
    cases.withColumn("unused", F.lit("x")).write.parquet(str(tmp_path / "cases"))
    spark.read.parquet(str(tmp_path / "cases")).createOrReplaceTempView("sql_stored")
    create_ranking_functions(spark, "stored", "sql_stored", "s 0", "a label", ["the arm"])
    plan = spark.sql("SELECT `the arm`, auroc FROM stored_auroc() WHERE `the arm` = 'a'")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "unused" not in plan and "CartesianProduct" not in plan
    # Cells are found once however often the body names them.
    df = spark.sql("SELECT * FROM stored_auroc()")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    scans = plan.split("Final Plan")[-1].split("Initial Plan")[0]
    assert "PartitionFilters" in scans
    # Running sums are cut into ranges: the only windows over whole groups are those over the ranges' sums.
    assert "range_id" in plan
