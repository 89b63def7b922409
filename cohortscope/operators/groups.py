"""Per-group values and row choices that keep working when one group holds much of the table.

A window over a key sends all rows of a key to one task. Two forms avoid that:

* a group value (minimum year, smallest tier) is aggregated with map-side combine and joined back;
  adaptive execution splits the hot partitions of that join;
* "first row per key" is ``row_number() == 1``, which Spark prunes to one row per key on the map
  side (``WindowGroupLimit``) before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortscope.operators.prefix import running_totals
from cohortscope.operators.skew import join_aggregated


def with_group_values(df: DataFrame, keys: Sequence[str], **values: Column) -> DataFrame:
    """Add aggregates of each row's group as columns. Rows with a NULL key get NULLs."""
    per_group = df.groupBy(*keys).agg(*[v.alias(n) for n, v in values.items()])
    return join_aggregated(df, per_group, keys, "left")


def add_timepoint(df: DataFrame, key: str, year: str, name: str = "timepoint") -> DataFrame:
    """Years since the subject's first scan, over all scans of the subject."""
    dated = with_group_values(df, [key], _first_year=F.min(year))
    return dated.withColumn(name, F.col(year) - F.col("_first_year")).drop("_first_year")


def _total_order(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> list:
    """``order`` plus the remaining columns, so that ties are always cut the same way."""
    named = {o for o in order if isinstance(o, str)} | set(keys)
    rest = [
        F.col(f.name)
        for f in df.schema.fields
        if f.name not in named and not isinstance(f.dataType, (T.MapType, T.VariantType))
    ]
    return [*order, *rest]


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in ``order``; ties fall to the smallest remaining columns."""
    window = Window.partitionBy(*keys).orderBy(*_total_order(df, keys, order))
    return df.withColumn("_rn", F.row_number().over(window)).filter("_rn = 1").drop("_rn")


def last_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key in ``order`` (ascending column names)."""
    return first_per_group(df, keys, [F.col(c).desc() for c in order])


def dedupe_keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Sort and keep one row per key combination."""
    return first_per_group(df, keys, order)


def argmax_row_per_group(
    df: DataFrame, key: str, value: str, tie_order: Sequence[str]
) -> DataFrame:
    """The row with the largest value per key; the first in ``tie_order`` among equals."""
    return first_per_group(df, [key], [F.col(value).desc_nulls_last(), *tie_order])


def mark_duplicates(df: DataFrame, keys: Sequence[str], name: str = "is_duplicate") -> DataFrame:
    """Every row, marked if its key occurs more than once. A NULL key counts as a key.

    The counts are aggregated before the shuffle and joined back, so a hot key is split.
    """
    counts = df.groupBy(*keys).agg((F.count(F.lit(1)) > 1).alias(name))
    own = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"_k{i}") for i, k in enumerate(keys)]
    own += [F.col(k).isNull().alias(f"_n{i}") for i, k in enumerate(keys)]
    matched = [f"_k{i}" for i in range(len(keys))] + [f"_n{i}" for i in range(len(keys))]
    marked = join_aggregated(df.select("*", *own), counts.select(*own, name), matched)
    return marked.select(*df.columns, name)


def flag_duplicates(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Which rows repeat a key, and how often.

    Returns each distinct row with ``n_copies`` and ``n_duplicates``: the copies that come after the
    first row of their key. Copies are counted, never gathered, so a row repeated a billion times
    costs no more than one.
    """
    copies = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n_copies"))
    rest = [c for c in df.columns if c not in keys]
    ordered = [*order, *[c for c in rest if c not in order]]
    rank = F.struct(*ordered)
    lead = copies.groupBy(*keys).agg(F.min(rank).alias("_first"))
    marked = join_aggregated(copies, lead, keys, "left")
    is_first = F.coalesce(rank == F.col("_first"), F.lit(False))
    return marked.select(
        *df.columns,
        "n_copies",
        (F.col("n_copies") - is_first.cast("int")).alias("n_duplicates"),
    )


def minmax_scale_255(df: DataFrame, keys: Sequence[str], value: str, name: str = "scaled") -> DataFrame:
    """Scale each slice to whole numbers 0..255, rounding down; a flat slice becomes 0."""
    ranged = with_group_values(df, keys, _lo=F.min(value), _hi=F.max(value))
    span = F.col("_hi") - F.col("_lo")
    scaled = F.floor(F.lit(255.0) * (F.col(value) - F.col("_lo")) / span).cast("int")
    return ranged.withColumn(name, F.when(span > 0, scaled).otherwise(F.lit(0))).drop("_lo", "_hi")


def slice_numbers(df: DataFrame, key: str, order: str, extension: str = ".png") -> DataFrame:
    """Number the slices of a scan from 1 and name their files ``001.png`` ..

    ``order`` is unique within a scan. Adds ``slice_number`` and ``file_name``, NULL for slices
    without a scan or a place in it.
    """
    numbered = running_totals(df.withColumn("_one", F.lit(1)), order, ["_one"], by=[key])
    named = numbered.select(
        *df.columns,
        F.col("cum__one").alias("slice_number"),
        F.format_string(f"%03d{extension}", "cum__one").alias("file_name"),
    )
    without = F.col(key).isNull() | F.col(order).isNull()
    if isinstance(df.schema[order].dataType, (T.DoubleType, T.FloatType)):
        without = without | F.isnan(order)
    return named.unionByName(df.filter(without), allowMissingColumns=True)


def middle_element(df: DataFrame, key: str, order: str) -> DataFrame:
    """Element ``n // 2`` (counted from 0) of each sequence; ``order`` is unique within one.

    Elements without a sequence or a place in it are none to choose from and don't count.
    """
    numbered = running_totals(df.withColumn("_one", F.lit(1)), order, ["_one"], by=[key])
    middle = F.col("cum__one") - 1 == F.expr("total__one div 2")
    return numbered.filter(middle).select(*df.columns)
