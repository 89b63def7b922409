"""Mann-Whitney comparison of several datasets with one baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortscope.functions.normal import two_sided_p
from cohortscope.operators.prefix import running_totals
from cohortscope.operators.projection import drop_missing


def mann_whitney(df: DataFrame, value: str, dataset: str, baseline: str) -> DataFrame:
    """Two-sided U test of each other dataset against ``baseline``, all in one pass.

    ``u`` counts the pairs in which the baseline value is larger (ties one half). ``z`` has the tie
    and the continuity correction and ``p_value`` is the normal approximation, not meant for samples
    of eight values or fewer. For a dataset only its own distinct values matter once the number of
    baseline values below each is known, so no dataset is ever paired with another row by row.
    """
    cells = (
        drop_missing(df, [value, dataset])
        .groupBy(F.col(value).alias("v"), F.col(dataset).alias("d"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    is_base = F.col("d") == baseline
    per_value = cells.groupBy("v").agg(F.sum(F.when(is_base, F.col("n")).otherwise(0)).alias("b"))
    per_value = per_value.withColumn("b_ties", _ties(F.col("b")))
    base = running_totals(per_value, "v", ["b", "b_ties"]).select(
        "v",
        "b",
        (F.col("total_b") - F.col("cum_b")).alias("above"),
        F.col("total_b").alias("n_base"),
        F.col("total_b_ties").alias("base_ties"),
    )
    others = cells.filter(~is_base).join(base, "v")
    n, b = F.col("n"), F.col("b")
    per_dataset = others.groupBy(F.col("d").alias(dataset)).agg(
        F.max("n_base").alias("n_baseline"),
        F.sum("n").alias("n_other"),
        F.sum(n * (F.col("above") + b / F.lit(2.0))).alias("u"),
        (F.max("base_ties") + F.sum(_ties(n + b) - _ties(b))).alias("_ties"),
    )
    n1, n2 = F.col("n_baseline").cast("double"), F.col("n_other").cast("double")
    total = n1 + n2
    spread = per_dataset.withColumn(
        "_sd",
        F.sqrt(n1 * n2 / 12.0 * (total + 1.0 - F.col("_ties") / (total * (total - 1.0)))),
    )
    distance = F.abs(F.col("u") - n1 * n2 / 2.0) - F.lit(0.5)
    z = F.when(F.col("_sd") > 0, F.greatest(distance, F.lit(0.0)) / F.col("_sd"))
    return spread.withColumn("z", z).select(
        dataset, "n_baseline", "n_other", "u", "z", two_sided_p(F.col("z")).alias("p_value")
    )


def _ties(count):
    size = count.cast("double")
    return size * size * size - size


def bonferroni(tests: DataFrame, p: str = "p_value") -> DataFrame:
    """Add ``adjusted_p_value``: p times the number of tests, at most 1.

    ``tests`` has one row per comparison, so its window holds a handful of rows.
    """
    n_tests = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    return tests.withColumn("adjusted_p_value", F.least(F.col(p) * n_tests, F.lit(1.0)))
