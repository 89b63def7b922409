"""Running totals over a global order, without putting the order into one task.

A window ordered over a whole table runs in a single task. Curves, ranks and exact percentiles all
need such an order, so they share the two-level prefix sum below: cut the order into ranges, total
each range, and add the totals of the earlier ranges to a running sum inside each range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortscope.operators.projection import drop_missing

# Offsets of an ungrouped order are broadcast up to this many rows; each is a few numbers.
MAX_BROADCAST_RANGES = 100_000
SAMPLES_PER_RANGE = 8
RANGE_COLUMN = "range_id"


def default_ranges(df: DataFrame) -> int:
    """As many ranges as the session shuffles into: results don't depend on it, only the tasks do."""
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def range_splits(cells: DataFrame, order: str, by: Sequence[str], ranges: int) -> Column:
    """Sorted split points as a scalar subquery of ``ranges - 1`` values.

    They are quantiles of a sample of ``SAMPLES_PER_RANGE`` cells per range, the cells with the
    smallest hashes: a uniform sample that depends on the data alone, so every evaluation of the
    subquery, retries included, finds the same splits. All cell columns take part in the sort, which
    keeps the plan below it equal to the main branch, so that Spark reuses that shuffle instead of
    aggregating the input again.
    """
    rest = [c for c in cells.columns if c != order and c not in by]
    sample = cells.orderBy(F.xxhash64(*by, order), *rest).limit(SAMPLES_PER_RANGE * ranges)
    ordered = sample.agg(F.array_sort(F.collect_list(order)).alias("o"))
    quantiles = F.transform(
        F.sequence(F.lit(1), F.lit(ranges - 1)),
        lambda i: F.get("o", F.floor(i * F.size("o") / F.lit(ranges)).cast("int")),
    )
    return ordered.select(quantiles.alias("splits")).scalar()


def range_of(value: Column, splits: Column, ranges: int) -> Column:
    """How many split points are <= ``value``: a binary search, about log2(ranges) steps."""
    steps = [1 << i for i in range(max(1, ranges.bit_length()) - 1, -1, -1)]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda low, step: F.when(F.get(splits, low + step - 1) <= value, low + step).otherwise(low),
    )


def place_in_ranges(
    cells: DataFrame, order: str, by: Sequence[str] = (), ranges: int | None = None
) -> DataFrame:
    """Add ``range_id``: about equally many cells per range, ranges ascending along ``order``."""
    by = list(by)
    ranges = ranges or default_ranges(cells)
    # Said before the plan branches, it keeps the branches' scans equal.
    cells = drop_missing(cells, [*by, order])
    placed = cells.withColumn("_splits", range_splits(cells, order, by, ranges))
    # explode() rather than a plain projection: the optimizer would otherwise copy the expression
    # that defines the range into filters on the other side of a join on it.
    return placed.select(
        *cells.columns,
        F.explode(F.array(range_of(F.col(order), F.col("_splits"), ranges))).alias(RANGE_COLUMN),
    )


def running_totals(
    cells: DataFrame,
    order: str,
    values: Sequence[str],
    by: Sequence[str] = (),
    descending: bool = False,
    ranges: int | None = None,
) -> DataFrame:
    """Add ``cum_<v>`` (inclusive running sum) and ``total_<v>`` (group sum) for each of ``values``.

    ``cells`` holds one row per (``by``, ``order``), both non-null: aggregate first, so that a value
    shared by a third of all rows is one cell. No task sees more than one range of one group, and a
    range holds about ``1 / ranges`` of all cells whatever the groups' sizes are. The offsets table
    has at most ``ranges`` rows per group. ``ranges=1`` is a plain window per group, for callers
    that have checked how large a group can be.
    """
    by, values = list(by), list(values)
    ranges = ranges or default_ranges(cells)
    cells = drop_missing(cells, [*by, order])
    if ranges == 1:
        return _plain_totals(cells, order, values, by, descending)
    placed = place_in_ranges(cells, order, by, ranges)

    along = F.col(RANGE_COLUMN).desc() if descending else F.col(RANGE_COLUMN).asc()
    group = by or [F.lit(0)]
    before = Window.partitionBy(*group).orderBy(along).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    totals = placed.groupBy(*by, RANGE_COLUMN).agg(*[F.sum(v).alias(f"_sum_{v}") for v in values])
    offsets = totals.select(
        *by,
        RANGE_COLUMN,
        *[F.coalesce(F.sum(f"_sum_{v}").over(before), F.lit(0)).alias(f"_before_{v}") for v in values],
        *[F.sum(f"_sum_{v}").over(whole).alias(f"total_{v}") for v in values],
    )

    within_order = F.col(order).desc() if descending else F.col(order).asc()
    within = (
        Window.partitionBy(*by, RANGE_COLUMN)
        .orderBy(within_order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # Without groups the offsets are at most `ranges` rows and are broadcast. With groups their
    # number is not bounded: Spark sorts and merges both sides on the window's own keys, can spill,
    # and the window reuses the order of the keys.
    if not by and ranges <= MAX_BROADCAST_RANGES:
        offsets = F.broadcast(offsets)
    joined = placed.join(offsets, [*by, RANGE_COLUMN])
    return joined.select(
        *cells.columns,
        *[(F.sum(v).over(within) + F.col(f"_before_{v}")).alias(f"cum_{v}") for v in values],
        *[f"total_{v}" for v in values],
    )


def _plain_totals(cells, order, values, by, descending) -> DataFrame:
    group = by or [F.lit(0)]
    along = F.col(order).desc() if descending else F.col(order).asc()
    running = (
        Window.partitionBy(*group)
        .orderBy(along)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    whole = Window.partitionBy(*group)
    return cells.select(
        *cells.columns,
        *[F.sum(v).over(running).alias(f"cum_{v}") for v in values],
        *[F.sum(v).over(whole).alias(f"total_{v}") for v in values],
    )


def value_counts_ordered(
    df: DataFrame, value: str, by: Sequence[str] = (), ranges: int | None = None
) -> DataFrame:
    """Distinct values per group with ``n``, ``cum_n`` and ``total_n`` in ascending order.

    Missing values and group keys are left out, as in a pandas groupby.
    """
    by = list(by)
    cells = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    return running_totals(cells, value, ["n"], by, ranges=ranges)


def exact_percentiles(
    df: DataFrame,
    value: str,
    fractions: dict[str, float],
    by: Sequence[str] = (),
    ranges: int | None = None,
) -> DataFrame:
    """Linear-interpolated percentiles per group, one column per entry of ``fractions``.

    Spark's own ``percentile`` keeps every distinct value of a group in one buffer. Here the value
    at a position is read off the running counts, so a group may be as large as the table.
    """
    ordered = value_counts_ordered(df, value, by, ranges)
    number = F.col(value).cast("double")
    picks = []
    for name, fraction in fractions.items():
        position = (F.col("total_n") - 1) * F.lit(float(fraction))
        for suffix, rank in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            here = (F.col("cum_n") - F.col("n") <= rank) & (rank < F.col("cum_n"))
            picks.append(F.max(F.when(here, number)).alias(f"_{name}_{suffix}"))
        picks.append(F.max(position - F.floor(position)).alias(f"_{name}_part"))
    found = ordered.groupBy(*by).agg(F.max("total_n").alias("n"), *picks)
    return found.select(
        *by,
        "n",
        *[
            (
                F.col(f"_{name}_lo")
                + (F.col(f"_{name}_hi") - F.col(f"_{name}_lo")) * F.col(f"_{name}_part")
            ).alias(name)
            for name in fractions
        ],
    )


def with_row_index(df: DataFrame, key: str, ranges: int | None = None) -> DataFrame:
    """Number the rows 0..n-1 along a unique, non-null ``key``; adds ``row_index`` and ``n_rows``."""
    numbered = running_totals(df.withColumn("_one", F.lit(1)), key, ["_one"], ranges=ranges)
    return numbered.select(
        *df.columns,
        (F.col("cum__one") - 1).alias("row_index"),
        F.col("total__one").alias("n_rows"),
    )
