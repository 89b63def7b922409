"""Exact percentiles and box-plot data by refined histograms.

A first pass counts rows per bucket of values, about a thousandth wide in proportion, and keeps their sums, smallest and
largest value; only these counts are shuffled. They tell in which bucket each wanted rank lies. A second pass counts
the distinct values of those buckets alone, and the rank is read off. So however many distinct values a table has, what
moves is a row per bucket and task, and the few buckets that hold an answer.

The counts are a table in the shared folder, and the list of wanted buckets is small: it is broadcast up to
``MAX_WANTED`` rows, which is checked, and joined otherwise, where very many groups are summarised at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortscope.operators.prefix import running_totals
from cohortscope.operators.projection import drop_missing
from cohortscope.operators.skew import join_aggregated
from cohortscope.session import scratch_dir

#: Buckets per natural logarithm of a value, and what keeps the logarithm of the smallest number positive.
FINENESS = 1024
LIFT = 745
LARGEST = 1.7976931348623157e308
MAX_WANTED = 100_000
BUCKET = "_bucket"


def bucket_of(value: Column) -> Column:
    """A number that never falls as the value rises."""
    x = value.cast("double")
    size = F.floor((F.ln(F.least(F.abs(x), F.lit(LARGEST))) + LIFT) * FINENESS) + 1
    return F.when(x > 0, size).when(x < 0, -size).otherwise(0).cast("int")


def _stored(df: DataFrame, label: str) -> DataFrame:
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """One row per group and bucket: ``n``, ``s`` (sum), ``lo``, ``hi``, and ``cum_n``, ``total_n`` along the buckets.

    Groups have a few thousand buckets, three millions at the very most, so one window per group orders them.
    """
    number = F.col(value).cast("double")
    counts = df.groupBy(*by, bucket_of(F.col(value)).alias(BUCKET)).agg(
        F.count(F.lit(1)).alias("n"), F.sum(number).alias("s"), F.min(number).alias("lo"), F.max(number).alias("hi")
    )
    ordered = running_totals(counts, BUCKET, ["n"], by, ranges=1)
    return _stored(ordered, "buckets")


def values_in(df: DataFrame, value: str, by: Sequence[str], wanted: DataFrame) -> DataFrame:
    """Distinct values, with ``n``, of the rows of ``df`` that lie in ``wanted`` (by, bucket) buckets."""
    keys = [*by, BUCKET]
    wanted = _stored(wanted.select(*keys), "wanted-buckets")
    rows = df.select(*by, F.col(value).cast("double").alias("v"), bucket_of(F.col(value)).alias(BUCKET))
    if wanted.count() <= MAX_WANTED:
        kept = rows.join(F.broadcast(wanted), keys, "left_semi")
    else:
        kept = join_aggregated(rows, wanted, keys, "left_semi")
    return kept.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n"))


def _ranks(fraction: float) -> tuple[Column, Column, Column]:
    """The two ranks that a percentile lies between, and how far."""
    position = (F.col("total_n") - 1) * F.lit(float(fraction))
    return F.floor(position), F.ceil(position), position - F.floor(position)


def _holds(rank: Column) -> Column:
    return (F.col("cum_n") - F.col("n") <= rank) & (rank < F.col("cum_n"))


def _percentiles(present: DataFrame, value: str, by: list[str], buckets: DataFrame, fractions: dict[str, float]) -> DataFrame:
    """``by``, ``n``, ``mean`` and the percentiles, from the buckets and the values of those that hold a rank."""
    any_rank = F.lit(False)
    for fraction in fractions.values():
        low, high, _ = _ranks(fraction)
        any_rank = any_rank | _holds(low) | _holds(high)
    wanted = buckets.filter(any_rank)
    cells = running_totals(values_in(present, value, by, wanted), "v", ["n"], [*by, BUCKET])
    starts = wanted.select(*by, BUCKET, (F.col("cum_n") - F.col("n")).alias("_before"), F.col("total_n").alias("_all"))
    values = join_aggregated(cells, starts, [*by, BUCKET]).select(
        *by, "v", "n", (F.col("_before") + F.col("cum_n")).alias("cum_n"), F.col("_all").alias("total_n")
    )
    both = values.unionByName(buckets.select(*by, "s", F.col("n").alias("_n"), "total_n"), allowMissingColumns=True)
    picks = []
    for name, fraction in fractions.items():
        low, high, part = _ranks(fraction)
        picks += [F.max(F.when(_holds(r), F.col("v"))).alias(f"_{name}_{e}") for r, e in ((low, "lo"), (high, "hi"))]
        picks.append(F.max(part).alias(f"_{name}_part"))
    found = both.groupBy(*by).agg(F.max("total_n").alias("n"), (F.sum("s") / F.sum("_n")).alias("mean"), *picks)
    between = [
        (F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_part")).alias(n) for n in fractions
    ]
    return found.select(*by, "n", "mean", *between)


def selected_percentiles(df: DataFrame, value: str, fractions: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """``n``, ``mean`` and linear-interpolated percentiles per group, a column per entry of ``fractions``.

    Missing values and group keys are left out. Groups may be as large as the table.
    """
    by = list(by)
    present = drop_missing(df.select(*dict.fromkeys([*by, value])), [*by, value])
    return _percentiles(present, value, by, bucketed(present, value, by), fractions)


def box_summary(df: DataFrame, value: str, by: Sequence[str], reach: float = 1.5) -> DataFrame:
    """``n``, quartiles, whiskers (the furthest values within ``reach`` quartile distances) and ``n_outliers`` per group.

    Whiskers come from the buckets as a whole where these lie on one side of a fence, and from their values where a
    fence runs through them.
    """
    by = list(by)
    if not by:
        return box_summary(df.withColumn("_whole", F.lit(0)), value, ["_whole"], reach).drop("_whole")
    present = drop_missing(df.select(*dict.fromkeys([*by, value])), [*by, value])
    buckets = bucketed(present, value, by)
    quartiles = _stored(_percentiles(present, value, by, buckets, {"q1": 0.25, "median": 0.5, "q3": 0.75}), "quartiles")
    distance = F.lit(reach) * (F.col("q3") - F.col("q1"))
    fences = quartiles.select(*by, (F.col("q1") - distance).alias("_low"), (F.col("q3") + distance).alias("_high"))
    sided = join_aggregated(buckets, fences, by)
    cut = ((F.col("lo") < F.col("_low")) & (F.col("hi") >= F.col("_low"))) | (
        (F.col("lo") <= F.col("_high")) & (F.col("hi") > F.col("_high"))
    )
    cells = values_in(present, value, by, sided.filter(cut))
    cells = join_aggregated(cells, fences, by).select(
        *by, "_low", "_high", "n", F.col("v").alias("lo"), F.col("v").alias("hi")
    )
    pieces = sided.filter(~cut).select(*by, "_low", "_high", "n", "lo", "hi").unionByName(cells)
    inside = (F.col("lo") >= F.col("_low")) & (F.col("hi") <= F.col("_high"))
    ends = pieces.groupBy(*by).agg(
        F.min(F.when(inside, F.col("lo"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("hi"))).alias("whisker_high"),
        F.sum(F.when(inside, 0).otherwise(F.col("n"))).alias("n_outliers"),
    )
    return quartiles.join(ends, by).select(*by, "n", "q1", "median", "q3", "whisker_low", "whisker_high", "n_outliers")
