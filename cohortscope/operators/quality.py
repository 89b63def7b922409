"""Data-quality checks. They report; ``strict`` ones raise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check_not_null(df: DataFrame, columns: Sequence[str], strict: bool = False) -> DataFrame:
    """Number of NULLs per column; ``strict`` raises if there is any."""
    report = null_profile(df, columns)
    if strict:
        bad = [r["column_name"] for r in report.filter("n_null > 0").collect()]
        if bad:
            raise ValueError(f"NULL values in {', '.join(sorted(bad))}")
    return report


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows, NULL count and NULL percentage per column, all columns in one pass."""
    columns = list(columns or df.columns)
    wide = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"_null_{i}") for i, c in enumerate(columns)],
    )
    entries = [
        F.struct(F.lit(c).alias("column_name"), F.col(f"_null_{i}").alias("n_null"))
        for i, c in enumerate(columns)
    ]
    tall = wide.select("_rows", F.inline(F.array(*entries)))
    return tall.select(
        "column_name",
        F.col("_rows").alias("n_rows"),
        "n_null",
        (F.col("n_null") * 100.0 / F.col("_rows")).alias("pct_null"),
    )


def check_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key combinations that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def check_implies(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Counts for ``a <=> b`` in both directions; unknown conditions count as false."""
    left, right = F.coalesce(a, F.lit(False)), F.coalesce(b, F.lit(False))
    return df.agg(
        F.count_if(left).alias("n_a"),
        F.count_if(right).alias("n_b"),
        F.count_if(left & ~right).alias("a_without_b"),
        F.count_if(right & ~left).alias("b_without_a"),
    )


def implies_violations(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Rows where exactly one of the two conditions holds."""
    return df.filter(F.coalesce(a, F.lit(False)) != F.coalesce(b, F.lit(False)))


def keys_match(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that occur in only one of two tables, with the side they come from."""
    sides = a.select(key, F.lit(1).alias("_in_a"), F.lit(0).alias("_in_b")).unionAll(
        b.select(key, F.lit(0).alias("_in_a"), F.lit(1).alias("_in_b"))
    )
    per_key = sides.groupBy(key).agg(F.max("_in_a").alias("_in_a"), F.max("_in_b").alias("_in_b"))
    only = F.when(F.col("_in_b") == 0, "a").when(F.col("_in_a") == 0, "b")
    return per_key.select(key, only.alias("only_in")).filter(F.col("only_in").isNotNull())


def check_size(df: DataFrame, expected: int) -> DataFrame:
    """Whether the table has the expected number of rows."""
    n = F.count(F.lit(1))
    return df.agg(n.alias("n_rows"), (n == expected).alias("as_expected"))


def check_equal_counts(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Whether two conditions select equally many rows."""
    n_a, n_b = F.count_if(a), F.count_if(b)
    return df.agg(n_a.alias("n_a"), n_b.alias("n_b"), (n_a == n_b).alias("equal"))


def selection_funnel(df: DataFrame, key: str, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows and subjects left after each exclusion step.

    ``steps`` are (name, condition to stay). A row leaves at the first condition it fails; a subject
    leaves with its last row. Step 0 is the input.
    """
    failed = F.lit(len(steps) + 1)
    for number in range(len(steps), 0, -1):
        stays = F.coalesce(steps[number - 1][1], F.lit(False))
        failed = F.when(~stays, F.lit(number)).otherwise(failed)
    leaving = df.select(F.col(key).alias("_key"), failed.alias("_step"))
    subjects = leaving.groupBy("_key").agg(F.max("_step").alias("_step"))
    per_step = (
        leaving.groupBy("_step")
        .agg(F.count(F.lit(1)).alias("_rows"), F.lit(0).cast("long").alias("_keys"))
        .unionAll(
            subjects.groupBy("_step").agg(
                F.lit(0).cast("long").alias("_rows"), F.count("_key").alias("_keys")
            )
        )
    )
    names = F.array(*[F.lit(n) for n in ["input", *[n for n, _ in steps]]])
    # Every (step, count) adds to all steps before it: at most steps x steps small rows.
    spread = per_step.select(
        F.explode(F.sequence(F.lit(0), F.col("_step") - 1)).alias("step"), "_rows", "_keys"
    )
    frame = df.sparkSession.range(len(steps) + 1).select(F.col("id").cast("int").alias("step"))
    counted = spread.groupBy("step").agg(F.sum("_rows").alias("n"), F.sum("_keys").alias("k"))
    return frame.join(counted, "step", "left").select(
        "step",
        F.get(names, F.col("step")).alias("step_name"),
        F.coalesce("n", F.lit(0)).alias("n_rows"),
        F.coalesce("k", F.lit(0)).alias("n_subjects"),
    )
