"""Numbers of distinct keys from sketches that are stored per group and merged without the rows.

A sketch holds a few thousand bytes whatever it has seen, so a step, folder or day is sketched once by the job
that handles it, and any later question about several of them reads sketches only. An estimate's standard
error is ``relative_error``; ``n_unique`` stays the exact form.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the sketch: the range of sizes that Spark accepts, as a power of two.
LG_SIZES = range(4, 22)
LG_SIZE = 14


def relative_error(lg_size: int = LG_SIZE) -> float:
    """One standard error of an estimate from merged sketches, as a share of the true number."""
    return 1.04 / math.sqrt(1 << lg_size)


def _key(df: DataFrame, key: str) -> Column:
    """The key in a type that sketches take."""
    kind = df.schema[key].dataType.typeName()
    if kind in ("integer", "long", "string", "binary"):
        return F.col(key)
    return F.col(key).cast("long" if kind in ("byte", "short") else "string")


def distinct_sketches(df: DataFrame, key: str, by: Sequence[str] = (), lg_size: int = LG_SIZE) -> DataFrame:
    """One row per group: its number of rows and a sketch of its distinct keys. NULL keys don't count."""
    if lg_size not in LG_SIZES:
        raise ValueError(f"lg_size between {LG_SIZES[0]} and {LG_SIZES[-1]}")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.hll_sketch_agg(_key(df, key), F.lit(lg_size)).alias("sketch")
    )


def funnel_sketches(df: DataFrame, key: str, steps: Sequence[tuple[str, Column]], lg_size: int = LG_SIZE) -> DataFrame:
    """Per exclusion step, what ``selection_funnel`` counts, as rows left and a sketch of the subjects left.

    One pass: every step aggregates beside the others, and only sketches are shuffled, no keys. Funnels of
    several sites or days, stacked, merge by step.
    """
    left, conditions = F.lit(True), [("input", F.lit(True))]
    for name, stays in steps:
        left = left & F.coalesce(stays, F.lit(False))
        conditions.append((name, left))
    value = _key(df, key)
    wide = df.agg(
        *[F.count_if(c).alias(f"n{i}") for i, (_, c) in enumerate(conditions)],
        *[F.hll_sketch_agg(F.when(c, value), F.lit(lg_size)).alias(f"s{i}") for i, (_, c) in enumerate(conditions)],
    )
    rows = [
        F.struct(F.lit(i).alias("step"), F.lit(name).alias("step_name"), F.col(f"n{i}").alias("n_rows"), F.col(f"s{i}").alias("sketch"))
        for i, (name, _) in enumerate(conditions)
    ]
    return wide.select(F.inline(F.array(*rows)))


def merge_sketches(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sketches of whole groups from those of their parts, however many; sizes may differ."""
    return sketches.groupBy(*by).agg(
        F.sum("n_rows").alias("n_rows"), F.hll_union_agg("sketch", F.lit(True)).alias("sketch")
    )


def estimates(sketches: DataFrame, name: str = "n_distinct") -> DataFrame:
    """The sketches' estimates instead of the sketches."""
    return sketches.withColumn(name, F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0))).drop("sketch")
