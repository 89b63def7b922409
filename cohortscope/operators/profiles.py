"""Counts, rates and distribution summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortscope.operators.histogram import box_summary, selected_percentiles
from cohortscope.operators.prefix import running_totals
from cohortscope.operators.projection import drop_missing


def feature_combinations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How often each combination of values occurs, most frequent first; NULL keys are left out."""
    counts = drop_missing(df, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), *keys)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Frequency of each value of one column."""
    return drop_missing(df, [column]).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def count_or_zero(counts: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Counts of the listed values, 0 for those that do not occur."""
    kind = counts.schema[column].dataType.simpleString()
    wanted = counts.sparkSession.createDataFrame([(v,) for v in values], f"{column} {kind}")
    return wanted.join(counts, column, "left").fillna(0, ["n"])


def dataset_statistics(df: DataFrame, event: str = "event") -> DataFrame:
    """Cases, events, non-events and their percentages in one pass."""
    events = F.sum(F.col(event).cast("long"))
    n = F.count(F.lit(1))
    return df.agg(
        n.alias("n"),
        events.alias("n_events"),
        (events * 100.0 / n).alias("pct_events"),
        (n - events).alias("n_no_events"),
        ((n - events) * 100.0 / n).alias("pct_no_events"),
    )


def positive_rate(event: Column) -> Column:
    """Share of positive rows, as an aggregate."""
    return F.avg(event.cast("double"))


def conditional_median(df: DataFrame, value: str, event: str = "event") -> DataFrame:
    """Median per event class."""
    return selected_percentiles(df, value, {"median": 0.5}, [event]).drop("mean")


def mean_ci(
    df: DataFrame,
    value: str,
    by: Sequence[str] = (),
    lower: float = 0.025,
    upper: float = 0.975,
) -> DataFrame:
    """Mean and linear-interpolated percentiles per group, for groups of any size."""
    found = selected_percentiles(df, value, {"lower_bound": lower, "upper_bound": upper}, by)
    return found.select(*by, "mean", "lower_bound", "upper_bound")


def five_number_summary(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Box-plot data per group: quartiles, whiskers inside 1.5 IQR and the number of outliers."""
    return box_summary(df, value, by)


def all_hold(condition: Column) -> Column:
    """True if the condition holds for every row of the group."""
    return F.bool_and(condition)


def any_hold(condition: Column) -> Column:
    """True if the condition holds for some row of the group."""
    return F.bool_or(condition)


def average_ranks(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Mid-rank of each distinct value: ties share the mean of their positions."""
    cells = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    ordered = running_totals(cells, value, ["n"], by)
    rank = F.col("cum_n") - F.col("n") + (F.col("n") + 1) / F.lit(2.0)
    return ordered.select(*by, value, "n", rank.alias("avg_rank"))


def with_average_rank(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Add ``avg_rank`` to every row."""
    return df.join(average_ranks(df, value, by).drop("n"), [*by, value], "left")
