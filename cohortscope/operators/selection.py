"""Union of cohorts and selection by ordered acquisition rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortscope.operators.groups import with_group_values

# Fixed values: (batch, slice thickness, kernel) of axial scans in order of preference. Rules with
# the same batch are taken together; a later batch counts only for subjects still without a scan.
ACQUISITION_TIERS = [
    (1, 2.5, "STANDARD"),
    (1, 2.0, "B30f"),
    (2, 2.0, "FC51"),
    (3, 1.25, "STANDARD"),
    (4, 3.2, "C"),
    (5, 2.0, "C"),
    (6, 3.2, "D"),
    (7, 1.0, "B30f"),
]


def acquisition_tiers(
    thickness: str = "SliceThickness", kernel: str = "ConvolutionKernel", plane: str = "Orientation"
) -> list[tuple[int, Column]]:
    """``ACQUISITION_TIERS`` as (batch, predicate) pairs."""
    return [
        (batch, (F.col(thickness) == t) & (F.col(kernel) == k) & (F.col(plane) == "axial"))
        for batch, t, k in ACQUISITION_TIERS
    ]


def with_tiers(
    df: DataFrame, tiers: Sequence[tuple[int, Column]], include: Column | None = None
) -> DataFrame:
    """Rows some rule accepts, with ``tier`` (1-based rule number) and ``batch``.

    ``include`` marks rows taken as a last resort for subjects no rule covers.
    """
    rules = list(tiers)
    if include is not None:
        rules.append((max(b for b, _ in rules) + 1, include))
    tier = F.lit(None).cast("int")
    for number in range(len(rules), 0, -1):
        tier = F.when(rules[number - 1][1], F.lit(number)).otherwise(tier)
    batches = F.array(*[F.lit(b) for b, _ in rules])
    # Said as one condition on the columns, the rules can reach the scan. explode() keeps the optimizer
    # from copying the tier itself, and whatever defines its columns, into a second filter.
    some_rule = reduce(lambda a, b: a | b, [rule for _, rule in rules])
    ranked = df.filter(some_rule).select(*df.columns, F.explode(F.array(tier)).alias("tier"))
    ranked = ranked.filter(F.col("tier").isNotNull())
    return ranked.withColumn("batch", F.get(batches, F.col("tier") - 1))


def priority_tiers(
    df: DataFrame, key: str, tiers: Sequence[tuple[int, Column]], include: Column | None = None
) -> DataFrame:
    """All rows of the best batch each subject reaches, with their ``tier``.

    One aggregate and one join replace the chain of anti joins that a batch-by-batch selection needs.
    """
    ranked = with_tiers(df, tiers, include)
    best = with_group_values(ranked, [key], _best=F.min("batch"))
    return best.filter(F.col("batch") == F.col("_best")).select(*df.columns, "tier")


def stack_datasets(
    datasets: Mapping[str, DataFrame], name: str = "dataset_name"
) -> DataFrame:
    """Union of cohorts with different columns, each row tagged with its cohort's name."""
    tagged = [df.withColumn(name, F.lit(label)) for label, df in datasets.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
