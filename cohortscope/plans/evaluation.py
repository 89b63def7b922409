"""Evaluate a scored cohort: metrics per year, curves, concordance and intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from cohortscope.operators.bootstrap import bootstrap_exact, metric_ci
from cohortscope.operators.evaluation import ci_error_bars, pr_curve, roc_curve
from cohortscope.operators.joint_bootstrap import bootstrap_joint
from cohortscope.operators.survival import (
    concordance_index,
    survival_metrics,
    yearly_cases,
)


def bootstrap_intervals(
    df: DataFrame,
    key: str,
    scores: Sequence[str],
    time: str,
    event: str,
    n_replicates: int = 5000,
    seed: int = 42,
    method: str = "cells",
    with_c_index: bool = False,
) -> DataFrame:
    """``year``, ``metric``, mean and 95% interval; the C-index, if wanted, has no year.

    ``cells`` works at any size: tasks work out the draws of the cases they hold. ``exact`` joins draws to rows, which
    costs a row per replicate and case.
    """
    if method == "exact":
        values = bootstrap_exact(df, key, scores, time, event, n_replicates, seed, with_c_index)
    elif method == "cells":
        values = bootstrap_joint(df, key, scores, time, event, n_replicates, seed)
        if not with_c_index:
            values = values.filter("metric <> 'c_index'")
    else:
        raise ValueError("method is 'cells' or 'exact'")
    return metric_ci(values)


def evaluate_cohort(
    df: DataFrame,
    key: str,
    scores: Sequence[str],
    time: str = "years_to_event",
    event: str = "event",
    n_replicates: int = 5000,
    seed: int = 42,
    censoring: DataFrame | None = None,
    method: str = "cells",
    with_c_index: bool = False,
) -> dict[str, DataFrame]:
    """All evaluation tables of a scored cohort, each a lazy DataFrame.

    ``metrics`` (year, metric, value), ``roc`` and ``pr`` (curves per year), ``c_index``,
    ``intervals`` (year, metric, mean, bounds) and ``error_bars``.
    """
    yearly = yearly_cases(df, scores, time, event)
    metrics = survival_metrics(df, scores, time, event)
    intervals = bootstrap_intervals(
        df, key, scores, time, event, n_replicates, seed, method, with_c_index
    )
    return {
        "metrics": metrics,
        "roc": roc_curve(yearly, "score", "label", ["year"]),
        "pr": pr_curve(yearly, "score", "label", ["year"]),
        "c_index": concordance_index(df, scores, time, event, censoring),
        "intervals": intervals,
        "error_bars": ci_error_bars(metrics, intervals, ["year", "metric"]),
    }
