"""The shape of the physical plans: what is pruned, shared, split and broadcast."""

import re

import pytest
from pyspark.sql import functions as F

from cohortscope.operators.evaluation import ranking_metrics
from cohortscope.operators.groups import add_timepoint, minmax_scale_255
from cohortscope.operators.joins import anti_by_key, semi_by_key
from cohortscope.operators.profiles import feature_combinations, with_average_rank
from cohortscope.plans.cohort import select_scans
from tests.test_selection_and_joins import HEADER_COLUMNS, headers


@pytest.fixture
def settings(spark):
    """Change session settings for one test."""
    before = {}

    def change(**conf):
        for key, value in conf.items():
            key = "spark.sql." + key.replace("__", ".")
            before.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)

    yield change
    for key, value in before.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)


@pytest.fixture(scope="module")
def visits(spark, tmp_path_factory):
    """A stored table in which one subject and one score hold a third of the rows."""
    path = str(tmp_path_factory.mktemp("visits") / "t")
    draw = F.pmod(F.xxhash64("id"), F.lit(3000))
    rows = spark.range(600_000).select(
        "id",
        F.when(draw < 1000, F.lit(0)).otherwise(draw).alias("pid"),
        F.when(draw < 1000, F.lit(0.5)).otherwise(F.rand(1)).alias("score"),
        (F.col("id") % 8 + 1995).cast("int").alias("year"),
        (F.col("id") % 10 == 0).cast("int").alias("label"),
        F.lit("x" * 20).alias("unused"),
    )
    rows.repartition(8).write.parquet(path)
    return spark.read.parquet(path)


def executed(df):
    """The final adaptive plan after running the query, without the plans it started from."""
    df.collect()
    kept, skip_from = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        column = len(line) - len(line.lstrip(" :|+-"))
        if skip_from is not None and column < skip_from:
            skip_from = None
        if "== Initial Plan ==" in line:
            skip_from = column
        if skip_from is None:
            kept.append(line)
    return "\n".join(kept)


def test_metrics_share_one_scan_and_order_inside_ranges(visits):
    df = ranking_metrics(visits, "score", "label")
    plan = executed(df)
    assert plan.count("ReusedExchange") >= 2
    windows = re.findall(r"windowspecdefinition\(([^)]*)", plan)
    assert any("range_id" in w and "threshold" in w for w in windows)
    # The only window without a range as its key runs over the totals of the ranges.
    assert not any("threshold" in w and "range_id" not in w for w in windows)


def test_scans_read_only_what_is_needed(visits):
    plan = executed(ranking_metrics(visits, "score", "label"))
    schemas = set(re.findall(r"ReadSchema: struct<([^>]*)", plan))
    assert schemas == {"score:double,label:int"}
    plan = executed(feature_combinations(visits, ["year", "label"]))
    assert set(re.findall(r"ReadSchema: struct<([^>]*)", plan)) == {"year:int,label:int"}
    assert "PushedFilters: [IsNotNull" in plan


@pytest.mark.parametrize(
    "build",
    [
        lambda t: add_timepoint(t, "pid", "year"),
        lambda t: minmax_scale_255(t, ["pid"], "score"),
        lambda t: anti_by_key(t, t.filter("pid % 7 = 3"), "pid"),
        lambda t: semi_by_key(t, t.filter("year > 1990"), "pid"),
        lambda t: with_average_rank(t, "score"),
    ],
    ids=["add_timepoint", "minmax", "anti", "semi", "average_rank"],
)
def test_hot_keys_are_split(visits, settings, build):
    """With a third of the rows under one key, adaptive execution divides that key's partition."""
    settings(
        autoBroadcastJoinThreshold="-1",
        adaptive__autoBroadcastJoinThreshold="-1",
        shuffle__partitions="16",
        adaptive__advisoryPartitionSizeInBytes="200k",
        adaptive__skewJoin__skewedPartitionThresholdInBytes="400k",
        adaptive__skewJoin__skewedPartitionFactor="2",
    )
    plan = executed(build(visits))
    assert "skew=true" in plan


def test_selection_prunes_to_one_row_per_subject_before_shuffling(spark):
    plan = select_scans(spark.createDataFrame(headers(1), HEADER_COLUMNS))
    text = plan._jdf.queryExecution().executedPlan().toString()
    limits = [i for i, line in enumerate(text.splitlines()) if "WindowGroupLimit" in line]
    assert len(limits) == 2
    between = text.splitlines()[limits[0] : limits[1]]
    assert sum("Exchange" in line for line in between) == 1
    # Below the map-side limit there is no further shuffle: the scan feeds it directly.
    assert not any("Exchange" in line for line in text.splitlines()[limits[1] : limits[1] + 4])
