"""Time-dependent evaluation of per-year risk scores under censoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortscope.operators.evaluation import cumulative_cells, ranking_metrics, score_cells
from cohortscope.operators.prefix import running_totals
from cohortscope.operators.projection import drop_missing

METRICS = ("auroc", "auprc", "average_precision")


def yearly_cases(
    df: DataFrame, scores: Sequence[str], time: str, event: str, keep: Sequence[str] = ()
) -> DataFrame:
    """One row per case and year it counts in: ``year`` (from 1), ``score``, ``label``.

    For the year with index i a case is positive if its event came by i, negative if it was observed
    to i without one, and left out if it was censored earlier.
    """
    entries = []
    for i, score in enumerate(scores):
        positive = (F.col(event) == 1) & (F.col(time) <= i)
        label = F.when(positive, 1).when(F.col(time) >= i, 0)
        entries.append(
            F.struct(
                F.lit(i + 1).alias("year"), F.col(score).alias("score"), label.alias("label")
            )
        )
    return df.select(*keep, F.inline(F.array(*entries))).filter(F.col("label").isNotNull())


def tidy_metrics(wide: DataFrame, keys: Sequence[str], names: Sequence[str] = METRICS) -> DataFrame:
    """Metric columns to ``metric``, ``value`` rows."""
    entries = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in names]
    return wide.select(*keys, F.inline(F.array(*entries)))


def survival_metrics(
    df: DataFrame, scores: Sequence[str], time: str, event: str, by: Sequence[str] = ()
) -> DataFrame:
    """AUROC, AUPRC and average precision per year as ``year``, ``metric``, ``value``."""
    keys = [*by, "year"]
    yearly = yearly_cases(df, scores, time, event, keep=by)
    return tidy_metrics(ranking_metrics(yearly, "score", "label", keys), keys)


def censoring_distribution(
    df: DataFrame, time: str, event: str, by: Sequence[str] = ()
) -> DataFrame:
    """Kaplan-Meier survival of the censoring times: ``time``, ``n_at_risk``, ``n_censored``, ``g``."""
    by = list(by)
    cells = drop_missing(df, [time, event]).groupBy(*by, F.col(time).alias("time")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(event) == 0).alias("n_censored")
    )
    at_risk = running_totals(cells, "time", ["n"], by, descending=True)
    left = F.lit(1.0) - F.col("n_censored") / F.col("cum_n")
    factors = at_risk.select(
        *by,
        "time",
        F.col("cum_n").alias("n_at_risk"),
        "n_censored",
        F.when(left > 0, F.log(left)).otherwise(0.0).alias("log_factor"),
        F.when(left > 0, 0).otherwise(1).alias("emptied"),
    )
    product = running_totals(factors, "time", ["log_factor", "emptied"], by)
    g = F.when(F.col("cum_emptied") > 0, 0.0).otherwise(F.exp("cum_log_factor"))
    return product.select(*by, "time", "n_at_risk", "n_censored", g.alias("g"))


def comparable_cases(
    df: DataFrame, scores: Sequence[str], time: str, event: str, keep: Sequence[str] = ()
) -> DataFrame:
    """Rows (``t``, ``score``, ``label``) whose positives and negatives form the C-index pairs at t.

    An event at year t is compared with every case observed longer, by the score for year t. Events
    after the last scored year form no pairs of their own.
    """
    entries = []
    for i, score in enumerate(scores):
        label = F.when((F.col(event) == 1) & (F.col(time) == i), 1).when(F.col(time) > i, 0)
        entries.append(
            F.struct(F.lit(i).alias("t"), F.col(score).alias("score"), label.alias("label"))
        )
    return df.select(*keep, F.inline(F.array(*entries))).filter(F.col("label").isNotNull())


def concordance_index(
    df: DataFrame,
    scores: Sequence[str],
    time: str,
    event: str,
    censoring: DataFrame | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Censoring-weighted concordance (Uno et al. 2011) as ``n_pairs`` and ``c_index``.

    Times are whole years. ``censoring`` is a table (``time``, ``g``), by default the one estimated
    from the data itself; pairs at a time with g = 0 count nothing, and an event year that a given table
    lacks is an error. Because the weight depends on
    the event year only, the index is a weighted mean of one AUROC-like sum per year: no pairs are
    formed. NULL if no pair is comparable.
    """
    by = list(by)
    keys = [*by, "t"]
    if censoring is None:
        censoring = censoring_distribution(df, time, event)
    long = comparable_cases(df, scores, time, event, keep=by)
    points = cumulative_cells(score_cells(long, "score", "label", keys), keys)
    per_year = points.groupBy(*keys).agg(
        F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / F.lit(2.0))).alias("won"),
        (F.max("n_pos").cast("double") * F.max("n_neg")).alias("pairs"),
    )
    weights = censoring.select(F.col("time").cast("int").alias("t"), "g")
    weighted = per_year.join(weights, "t", "left")
    known = F.coalesce("g", F.when(F.col("pairs") > 0, F.raise_error(F.lit("an event year has no censoring weight"))))
    w = F.when(known > 0, F.lit(1.0) / (known * known)).otherwise(0.0)
    compared = F.sum(w * F.col("pairs"))
    return weighted.groupBy(*by).agg(
        F.sum("pairs").cast("long").alias("n_pairs"),
        F.when(compared > 0, F.sum(w * F.col("won")) / compared).alias("c_index"),
    )
