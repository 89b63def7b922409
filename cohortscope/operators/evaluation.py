"""Curves and summary metrics of a score against a 0/1 label.

Every metric is a sum over *distinct scores*, so rows are first reduced to one cell per score. Ties
count one half in the AUROC.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortscope.functions.outcomes import classify_at, outcome_label
from cohortscope.operators.prefix import running_totals


def score_cells(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """``threshold``, ``pos`` and ``neg`` counts per distinct score; other labels are left out."""
    threshold = F.col(score).cast("double")
    usable = df.filter(threshold.isNotNull() & ~F.isnan(threshold) & F.col(label).isin(0, 1))
    return usable.groupBy(*by, threshold.alias("threshold")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )


def cumulative_cells(
    cells: DataFrame, by: Sequence[str] = (), ranges: int | None = None
) -> DataFrame:
    """Cells with counts at or above their threshold (``tp``, ``fp``) and class totals."""
    summed = running_totals(
        cells, "threshold", ["pos", "neg"], by, descending=True, ranges=ranges
    )
    return summed.select(
        *by,
        "threshold",
        "pos",
        "neg",
        F.col("cum_pos").alias("tp"),
        F.col("cum_neg").alias("fp"),
        F.col("total_pos").alias("n_pos"),
        F.col("total_neg").alias("n_neg"),
    )


def _rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def precision_at() -> Column:
    return F.col("tp") / (F.col("tp") + F.col("fp"))


def precision_before() -> Column:
    """Precision one threshold higher; 1 before the first."""
    tp, fp = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    return F.coalesce(_rate(tp, tp + fp), F.lit(1.0))


def _with_anchor(points: DataFrame, keep: Sequence[str], anchor: dict, point: dict) -> DataFrame:
    """Put the curve's starting point (threshold infinity) in front of each group's first cell."""
    here = F.struct(*[v.alias(n) for n, v in point.items()])
    start = F.struct(*[F.lit(float(v)).alias(n) for n, v in anchor.items()])
    is_first = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
    both = F.when(is_first, F.array(start, here)).otherwise(F.array(here))
    return points.select(*keep, F.inline(both))


def roc_curve(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """``threshold``, ``fpr`` and ``tpr`` per group, starting at (0, 0)."""
    points = cumulative_cells(score_cells(df, score, label, by), by)
    return _with_anchor(
        points,
        by,
        {"threshold": "inf", "fpr": 0, "tpr": 0},
        {
            "threshold": F.col("threshold"),
            "fpr": _rate(F.col("fp"), F.col("n_neg")),
            "tpr": _rate(F.col("tp"), F.col("n_pos")),
        },
    )


def pr_curve(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """``threshold``, ``precision`` and ``recall`` per group, starting at recall 0, precision 1."""
    points = cumulative_cells(score_cells(df, score, label, by), by)
    return _with_anchor(
        points,
        by,
        {"threshold": "inf", "precision": 1, "recall": 0},
        {
            "threshold": F.col("threshold"),
            "precision": precision_at(),
            "recall": _rate(F.col("tp"), F.col("n_pos")),
        },
    )


def summarise_cells(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """AUROC and both areas under the PR curve from cumulative cells.

    ``auprc`` is the trapezoid area, ``average_precision`` the step sum. A group that lacks a class
    has NULL metrics.
    """
    both = (F.max("n_pos") > 0) & (F.max("n_neg") > 0)
    pairs = F.max("n_pos").cast("double") * F.max("n_neg")
    won = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / F.lit(2.0)))
    steps = F.sum(F.col("pos") * precision_at())
    areas = F.sum(F.col("pos") * (precision_at() + precision_before()) / F.lit(2.0))
    return points.groupBy(*by).agg(
        F.max("n_pos").alias("n_pos"),
        F.max("n_neg").alias("n_neg"),
        F.when(both, won / pairs).alias("auroc"),
        F.when(both, areas / F.max("n_pos")).alias("auprc"),
        F.when(both, steps / F.max("n_pos")).alias("average_precision"),
    )


def ranking_metrics(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Class counts, AUROC, AUPRC and average precision per group."""
    return summarise_cells(cumulative_cells(score_cells(df, score, label, by), by), by)


def auroc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve."""
    return ranking_metrics(df, score, label, by).select(*by, "auroc")


def auprc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the PR curve: trapezoid (``auprc``) and step-wise (``average_precision``)."""
    return ranking_metrics(df, score, label, by).select(*by, "auprc", "average_precision")


def youden_threshold(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Threshold with the largest tpr - fpr; the highest one among equals."""
    points = roc_curve(df, score, label, by).withColumn("youden", F.col("tpr") - F.col("fpr"))
    best = [F.col("youden").desc_nulls_last(), F.col("threshold").desc()]
    if not by:
        return points.orderBy(*best).limit(1)
    window = Window.partitionBy(*by).orderBy(*best)
    return points.withColumn("_rn", F.row_number().over(window)).filter("_rn = 1").drop("_rn")


def confusion_counts(
    df: DataFrame, label: str, score: str, cutoff: float, by: Sequence[str] = ()
) -> DataFrame:
    """TP, FP, FN and TN in one pass."""
    outcome = outcome_label(F.col(label), F.col(score), cutoff)
    return df.groupBy(*by).agg(
        *[F.count_if(outcome == kind).alias(kind.lower()) for kind in ("TP", "FP", "FN", "TN")]
    )


def confusion_matrix(df: DataFrame, label: str, score: str, cutoff: float) -> DataFrame:
    """Long 2x2 matrix (``actual``, ``predicted``, ``n``) with its zero cells."""
    cells = [
        F.struct(
            F.lit(actual).alias("actual"), F.lit(predicted).alias("predicted"), F.col(n).alias("n")
        )
        for actual, predicted, n in ((1, 1, "tp"), (1, 0, "fn"), (0, 1, "fp"), (0, 0, "tn"))
    ]
    return confusion_counts(df, label, score, cutoff).select(F.inline(F.array(*cells)))


def with_outcome(
    df: DataFrame, label: str, score: str, cutoff: float, name: str = "outcome"
) -> DataFrame:
    """Add each row's binary prediction and its TP/FP/FN/TN label."""
    return df.withColumns(
        {
            "predicted": classify_at(F.col(score), cutoff),
            name: outcome_label(F.col(label), F.col(score), cutoff),
        }
    )


def misclassified(df: DataFrame, label: str, score: str, cutoff: float, kind: str) -> DataFrame:
    """Rows of one of the four sets."""
    return df.filter(outcome_label(F.col(label), F.col(score), cutoff) == kind)


def baseline_diagnosis_rate(df: DataFrame, labels: str, event: str, time: str) -> DataFrame:
    """Cases positive in year 0, and whether they are the events with time 0."""
    at_zero = F.count_if(F.get(labels, F.lit(0)) == 1)
    direct = F.count_if((F.col(event) == 1) & (F.col(time) == 0))
    n = F.count(F.lit(1))
    return df.agg(
        n.alias("n"),
        at_zero.alias("n_year0"),
        (at_zero * 100.0 / n).alias("pct_year0"),
        (at_zero == direct).alias("consistent"),
    )


def ci_error_bars(point: DataFrame, intervals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distances from the point metric (``value``) down and up to its interval."""
    return point.join(intervals, list(keys)).select(
        *keys,
        "value",
        (F.col("value") - F.col("lower_bound")).alias("error_low"),
        (F.col("upper_bound") - F.col("value")).alias("error_high"),
    )
