"""Curves, metrics, survival evaluation, bootstrap, rank tests and scoring."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from cohortscope.functions.survival import year_labels
from cohortscope.operators.bootstrap import bootstrap_cells, bootstrap_exact, metric_ci
from cohortscope.operators.evaluation import (
    auprc,
    auroc,
    baseline_diagnosis_rate,
    ci_error_bars,
    confusion_counts,
    confusion_matrix,
    misclassified,
    pr_curve,
    ranking_metrics,
    roc_curve,
    youden_threshold,
)
from cohortscope.operators.joint_bootstrap import LAST_SHIFT, MARGIN, MOST, ROUNDS, bootstrap_joint, mix
from cohortscope.operators.profiles import positive_rate
from cohortscope.operators.rank_tests import bonferroni, mann_whitney
from cohortscope.operators.scoring import score_cases, score_resume, score_with_features, unscored
from cohortscope.operators.survival import (
    censoring_distribution,
    concordance_index,
    survival_metrics,
    yearly_cases,
)
from cohortscope.plans.evaluation import evaluate_cohort
from cohortscope.session import scratch_dir
from workload.base import (
    COHORT_SQL,
    CUTOFF,
    FLAGGED_SQL,
    GRADED_SQL,
    SCORES,
    cohort,
    flagged,
    graded,
    query,
    rounded,
    table,
)


def points_sql(source: str, by: str = "", score: str = "score", label: str = "label") -> str:
    """CTEs ``cells`` and ``pts`` with cumulative counts per distinct score."""
    comma = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""
cells AS (
  SELECT {comma}{score} AS threshold, count(*) FILTER ({label} = 1) AS pos,
         count(*) FILTER ({label} = 0) AS neg
  FROM {source} WHERE {label} IN (0, 1) GROUP BY ALL),
pts AS (
  SELECT *, CAST(sum(pos) OVER ({part}ORDER BY threshold DESC) AS BIGINT) AS tp,
         CAST(sum(neg) OVER ({part}ORDER BY threshold DESC) AS BIGINT) AS fp,
         CAST(sum(pos) OVER ({part}) AS BIGINT) AS n_pos,
         CAST(sum(neg) OVER ({part}) AS BIGINT) AS n_neg
  FROM cells)"""


def areas_sql(by: str = "") -> str:
    """CTE ``areas`` with AUROC by trapezoids, AUPRC by trapezoids with ``lag``, and step sums."""
    comma = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""
lagged AS (
  SELECT *, fp / n_neg AS fpr, tp / n_pos AS tpr, tp / (tp + fp) AS prec,
         lag(fp / n_neg, 1, 0.0) OVER w AS fpr0, lag(tp / n_pos, 1, 0.0) OVER w AS tpr0,
         lag(tp / (tp + fp), 1, 1.0) OVER w AS prec0
  FROM pts WINDOW w AS ({part}ORDER BY threshold DESC)),
areas AS (
  SELECT {comma}max(n_pos) AS n_pos, max(n_neg) AS n_neg,
         sum((fpr - fpr0) * (tpr + tpr0) / 2) AS auroc,
         sum((tpr - tpr0) * (prec + prec0) / 2) AS auprc,
         sum((tpr - tpr0) * prec) AS average_precision
  FROM lagged {group})"""


@query(
    "roc_curve",
    f"""WITH {GRADED_SQL}, {points_sql('graded')}
        SELECT threshold, round(fp / n_neg, 9) AS fpr, round(tp / n_pos, 9) AS tpr FROM pts
        UNION ALL SELECT 'Infinity'::DOUBLE, 0.0, 0.0""",
)
def roc_curve_query(spark, sf_dir):
    curve = roc_curve(graded(spark, sf_dir), "score", "label")
    return curve.select("threshold", rounded("fpr"), rounded("tpr"))


@query(
    "roc_curve_by_arm",
    f"""WITH {FLAGGED_SQL}, {points_sql('flagged', 'arm', 'fine_score')}
        SELECT arm, threshold, round(fp / n_neg, 9) AS fpr, round(tp / n_pos, 9) AS tpr FROM pts
        UNION ALL SELECT DISTINCT arm, 'Infinity'::DOUBLE, 0.0, 0.0 FROM pts""",
)
def roc_curve_by_arm_query(spark, sf_dir):
    """Many distinct scores, two groups."""
    curve = roc_curve(flagged(spark, sf_dir), "fine_score", "label", ["arm"])
    return curve.select("arm", "threshold", rounded("fpr"), rounded("tpr"))


@query(
    "pr_curve",
    f"""WITH {GRADED_SQL}, {points_sql('graded')}
        SELECT threshold, round(tp / (tp + fp), 9) AS precision, round(tp / n_pos, 9) AS recall FROM pts
        UNION ALL SELECT 'Infinity'::DOUBLE, 1.0, 0.0""",
)
def pr_curve_query(spark, sf_dir):
    curve = pr_curve(graded(spark, sf_dir), "score", "label")
    return curve.select("threshold", rounded("precision"), rounded("recall"))


@query(
    "auroc",
    f"""WITH {FLAGGED_SQL}, {points_sql('flagged', 'arm', 'tied_score')}, {areas_sql('arm')}
        SELECT arm, round(auroc, 9) AS auroc FROM areas""",
)
def auroc_query(spark, sf_dir):
    """Heavily tied scores."""
    found = auroc(flagged(spark, sf_dir), "tied_score", "label", ["arm"])
    return found.select("arm", rounded("auroc"))


@query(
    "auprc",
    f"""WITH {FLAGGED_SQL}, {points_sql('flagged', '', 'fine_score')}, {areas_sql()}
        SELECT round(auprc, 9) AS auprc, round(average_precision, 9) AS average_precision FROM areas""",
)
def auprc_query(spark, sf_dir):
    found = auprc(flagged(spark, sf_dir), "fine_score", "label")
    return found.select(rounded("auprc"), rounded("average_precision"))


RANKING_COLUMNS = ("auroc", "auprc", "average_precision")


@query(
    "ranking_metrics",
    f"""WITH {GRADED_SQL}, {points_sql('graded')}, {areas_sql()}
        SELECT n_pos, n_neg, round(auroc, 9) AS auroc, round(auprc, 9) AS auprc,
               round(average_precision, 9) AS average_precision FROM areas""",
)
def ranking_metrics_query(spark, sf_dir):
    found = ranking_metrics(graded(spark, sf_dir), "score", "label")
    return found.select("n_pos", "n_neg", *[rounded(c) for c in RANKING_COLUMNS])


@query(
    "positive_rate_by_arm",
    f"WITH {FLAGGED_SQL} SELECT arm, round(avg(label), 9) AS rate FROM flagged GROUP BY 1",
)
def positive_rate_by_arm_query(spark, sf_dir):
    """The horizontal line of a PR plot."""
    return flagged(spark, sf_dir).groupBy("arm").agg(
        rounded(positive_rate(F.col("label")), 9, "rate")
    )


@query(
    "youden_threshold",
    f"""WITH {GRADED_SQL}, {points_sql('graded')},
        r AS (SELECT threshold, fp / n_neg AS fpr, tp / n_pos AS tpr FROM pts
              UNION ALL SELECT 'Infinity'::DOUBLE, 0.0, 0.0)
        SELECT threshold, round(fpr, 9) AS fpr, round(tpr, 9) AS tpr, round(tpr - fpr, 9) AS youden
        FROM r ORDER BY tpr - fpr DESC, threshold DESC LIMIT 1""",
)
def youden_threshold_query(spark, sf_dir):
    best = youden_threshold(graded(spark, sf_dir), "score", "label")
    return best.select("threshold", *[rounded(c) for c in ("fpr", "tpr", "youden")])


@query(
    "confusion_counts",
    f"""WITH {FLAGGED_SQL}
        SELECT arm, count(*) FILTER (label = 1 AND tied_score >= {CUTOFF}) AS tp,
               count(*) FILTER (label = 0 AND tied_score >= {CUTOFF}) AS fp,
               count(*) FILTER (label = 1 AND tied_score < {CUTOFF}) AS fn,
               count(*) FILTER (label = 0 AND tied_score < {CUTOFF}) AS tn FROM flagged GROUP BY 1""",
)
def confusion_counts_query(spark, sf_dir):
    return confusion_counts(flagged(spark, sf_dir), "label", "tied_score", CUTOFF, ["arm"])


@query(
    "confusion_matrix",
    f"""WITH {GRADED_SQL}
        SELECT a AS actual, p AS predicted,
               (SELECT count(*) FROM graded WHERE label = a AND CAST(score >= 0 AS INTEGER) = p) AS n
        FROM (VALUES (1, 1), (1, 0), (0, 1), (0, 0)) t(a, p)""",
)
def confusion_matrix_query(spark, sf_dir):
    """A cutoff of 0 leaves two zero cells, which stay in the result."""
    return confusion_matrix(graded(spark, sf_dir), "label", "score", 0.0)


@query(
    "misclassified",
    f"WITH {GRADED_SQL} SELECT doc_id, score, label FROM graded WHERE label = 1 AND score < 0.5",
)
def misclassified_query(spark, sf_dir):
    return misclassified(graded(spark, sf_dir), "label", "score", 0.5, "FN")


@query(
    "baseline_diagnosis_rate",
    f"""WITH {COHORT_SQL}
        SELECT count(*) AS n, count(*) FILTER (event = 1 AND years_to_event = 0) AS n_year0,
               round(100.0 * count(*) FILTER (event = 1 AND years_to_event = 0) / count(*), 9) AS pct_year0,
               true AS consistent FROM cohort""",
)
def baseline_diagnosis_rate_query(spark, sf_dir):
    labelled = cohort(spark, sf_dir).withColumn(
        "y", year_labels(F.col("event"), F.col("years_to_event"), 6)
    )
    rate = baseline_diagnosis_rate(labelled, "y", "event", "years_to_event")
    return rate.withColumn("pct_year0", F.round("pct_year0", 9))


# --- survival ---------------------------------------------------------------------------------

YEARLY_SQL = COHORT_SQL + ",\nyearly AS (\n" + "\n  UNION ALL ".join(
    f"""SELECT pid, {i + 1} AS year, {s} AS score,
         CASE WHEN event = 1 AND years_to_event <= {i} THEN 1 WHEN years_to_event >= {i} THEN 0 END AS label
         FROM cohort"""
    for i, s in enumerate(SCORES)
) + ")"

TIDY_SQL = """
(SELECT year, 'auroc' AS metric, auroc AS value FROM areas
 UNION ALL SELECT year, 'auprc', auprc FROM areas
 UNION ALL SELECT year, 'average_precision', average_precision FROM areas)"""


@query(
    "survival_metrics",
    f"""WITH {YEARLY_SQL}, {points_sql('yearly', 'year')}, {areas_sql('year')}
        SELECT year, metric, round(value, 9) AS value FROM {TIDY_SQL}""",
)
def survival_metrics_query(spark, sf_dir):
    """Time-dependent metrics per year; cases censored before a year are left out of it."""
    found = survival_metrics(cohort(spark, sf_dir), SCORES, "years_to_event", "event")
    return found.withColumn("value", F.round("value", 9))


@query(
    "yearly_roc_curve",
    f"""WITH {YEARLY_SQL}, {points_sql('yearly', 'year')}
        SELECT year, threshold, round(fp / n_neg, 9) AS fpr, round(tp / n_pos, 9) AS tpr FROM pts
        UNION ALL SELECT DISTINCT year, 'Infinity'::DOUBLE, 0.0, 0.0 FROM pts""",
)
def yearly_roc_curve_query(spark, sf_dir):
    yearly = yearly_cases(cohort(spark, sf_dir), SCORES, "years_to_event", "event")
    curve = roc_curve(yearly, "score", "label", ["year"])
    return curve.select("year", "threshold", rounded("fpr"), rounded("tpr"))


CENSORING_SQL = COHORT_SQL + """,
km0 AS (
  SELECT years_to_event AS time, count(*) AS n, count(*) FILTER (event = 0) AS n_censored
  FROM cohort WHERE years_to_event IS NOT NULL GROUP BY 1),
km1 AS (SELECT *, CAST(sum(n) OVER (ORDER BY time DESC) AS BIGINT) AS n_at_risk FROM km0),
km AS (
  SELECT time, n_at_risk, n_censored,
         CASE WHEN max(CAST(n_at_risk = n_censored AS INTEGER)) OVER (ORDER BY time) = 1 THEN 0.0
              ELSE exp(sum(CASE WHEN n_at_risk > n_censored THEN ln(1.0 - n_censored / n_at_risk) END)
                       OVER (ORDER BY time)) END AS g
  FROM km1)"""


@query(
    "censoring_distribution",
    f"WITH {CENSORING_SQL} SELECT time, n_at_risk, n_censored, round(g, 9) AS g FROM km",
)
def censoring_distribution_query(spark, sf_dir):
    g = censoring_distribution(cohort(spark, sf_dir), "years_to_event", "event")
    return g.withColumn("g", F.round("g", 9))


@query(
    "concordance_index",
    f"""WITH {CENSORING_SQL},
        scored AS (SELECT pid, event, years_to_event AS time, [{', '.join(SCORES)}] AS p FROM cohort),
        pairs AS (
          SELECT CASE WHEN g > 0 THEN 1.0 / (g * g) ELSE 0.0 END AS w,
                 CASE WHEN a.p[a.time + 1] > b.p[a.time + 1] THEN 1.0
                      WHEN a.p[a.time + 1] = b.p[a.time + 1] THEN 0.5 ELSE 0.0 END AS won
          FROM scored a JOIN scored b ON a.event = 1 AND a.time < b.time
          JOIN km ON km.time = a.time)
        SELECT count(*) AS n_pairs, round(sum(w * won) / sum(w), 9) AS c_index FROM pairs""",
)
def concordance_index_query(spark, sf_dir):
    """Compared with a statement that does form all pairs."""
    c = concordance_index(cohort(spark, sf_dir), SCORES, "years_to_event", "event")
    return c.select("n_pairs", rounded("c_index"))


# --- bootstrap --------------------------------------------------------------------------------


# Replicates of the registered bootstraps. ``bootstrap_joint`` draws as many as published evaluations do; those that
# resample rows draw enough for 2.5 % percentiles, and the last one's statement forms all pairs of every replicate.
JOINT_REPLICATES, REPLICATES, SURVIVAL_REPLICATES, CELL_REPLICATES, PAIR_REPLICATES = 5000, 1000, 200, 200, 40


def resampled_sql(source: str, key: str, replicates: int) -> str:
    """CTEs ``numbered`` and ``drawn``: row indexes from the same hash as the Spark side."""
    return f"""
numbered AS (
  SELECT *, row_number() OVER (ORDER BY {key}) - 1 AS idx, count(*) OVER () AS n_rows FROM {source}),
drawn AS (
  SELECT CAST(b AS INTEGER) AS replicate,
         ('0x' || substr(md5('42-' || b || '-' || idx), 1, 8))::BIGINT % n_rows AS pick
  FROM numbered, range({replicates}) t(b))"""


INTERVAL_SQL = """count(value) AS n_replicates, round(avg(value), 9) AS mean,
               round(quantile_cont(value, 0.025), 9) AS lower_bound,
               round(quantile_cont(value, 0.975), 9) AS upper_bound"""

GRADED_BOOT_SQL = f"""
WITH {GRADED_SQL}, {resampled_sql('graded', 'doc_id', REPLICATES)},
resampled AS (SELECT replicate, score, label FROM drawn JOIN numbered ON pick = idx),
{points_sql('resampled', 'replicate')}, {areas_sql('replicate')},
tidy AS (
  SELECT replicate, 1 AS year, 'auroc' AS metric, auroc AS value FROM areas WHERE n_pos > 0 AND n_neg > 0
  UNION ALL SELECT replicate, 1, 'auprc', auprc FROM areas WHERE n_pos > 0 AND n_neg > 0
  UNION ALL SELECT replicate, 1, 'average_precision', average_precision FROM areas
  WHERE n_pos > 0 AND n_neg > 0)"""


def graded_bootstrap(spark, sf_dir):
    """Everyone observed at time 0: the plain AUROC of a label."""
    cases = graded(spark, sf_dir).withColumn("time", F.lit(0))
    return bootstrap_exact(cases, "doc_id", ["score"], "time", "label", REPLICATES)


@query(
    "bootstrap",
    GRADED_BOOT_SQL + " SELECT replicate, year, metric, round(value, 9) AS value FROM tidy",
)
def bootstrap_query(spark, sf_dir):
    """Every replicate, drawn by the same hash on both sides."""
    return graded_bootstrap(spark, sf_dir).withColumn("value", F.round("value", 9))


@query("metric_ci", GRADED_BOOT_SQL + f" SELECT year, metric, {INTERVAL_SQL} FROM tidy GROUP BY 1, 2")
def metric_ci_query(spark, sf_dir):
    intervals = metric_ci(graded_bootstrap(spark, sf_dir))
    return intervals.withColumns(
        {c: F.round(c, 9) for c in ("mean", "lower_bound", "upper_bound")}
    )


@query(
    "ci_error_bars",
    GRADED_BOOT_SQL
    + f""", ci AS (SELECT year, metric, {INTERVAL_SQL} FROM tidy GROUP BY 1, 2),
        once AS (
          SELECT sum(neg * (tp - pos / 2)) / max(n_pos) / max(n_neg) AS auroc FROM (
            SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(pos) OVER () AS n_pos,
                   sum(neg) OVER () AS n_neg
            FROM (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg
                  FROM graded GROUP BY 1)))
        SELECT year, metric, round(auroc, 6) AS value, round(auroc - lower_bound, 6) AS error_low,
               round(upper_bound - auroc, 6) AS error_high FROM once, ci WHERE metric = 'auroc'""",
)
def ci_error_bars_query(spark, sf_dir):
    cases = graded(spark, sf_dir).withColumn("time", F.lit(0))
    point = survival_metrics(cases, ["score"], "time", "label").filter("metric = 'auroc'")
    bars = ci_error_bars(point, metric_ci(graded_bootstrap(spark, sf_dir)), ["year", "metric"])
    return bars.withColumns({c: F.round(c, 6) for c in ("value", "error_low", "error_high")})


@query(
    "bootstrap_survival",
    f"""WITH {YEARLY_SQL}, {resampled_sql('cohort', 'pid', SURVIVAL_REPLICATES)},
        resampled AS (
          SELECT replicate, year, score, label FROM drawn
          JOIN numbered ON pick = idx JOIN yearly ON numbered.pid = yearly.pid),
        {points_sql('resampled', 'replicate, year')}, {areas_sql('replicate, year')},
        tidy AS (SELECT year, 'auroc' AS metric, auroc AS value FROM areas
                 UNION ALL SELECT year, 'auprc', auprc FROM areas
                 UNION ALL SELECT year, 'average_precision', average_precision FROM areas)
        SELECT year, metric, {INTERVAL_SQL} FROM tidy GROUP BY 1, 2""",
)
def bootstrap_survival_query(spark, sf_dir):
    """Intervals of all yearly metrics; a resampled case brings all its years."""
    values = bootstrap_exact(
        cohort(spark, sf_dir), "pid", SCORES, "years_to_event", "event", SURVIVAL_REPLICATES
    )
    return metric_ci(values).withColumns(
        {c: F.round(c, 9) for c in ("mean", "lower_bound", "upper_bound")}
    )


@query(
    "bootstrap_c_index",
    f"""WITH {CENSORING_SQL}, {resampled_sql('cohort', 'pid', PAIR_REPLICATES)},
        s AS (SELECT replicate, event, years_to_event AS time, [{', '.join(SCORES)}] AS p
              FROM drawn JOIN numbered ON pick = idx),
        pairs AS (
          SELECT a.replicate, CASE WHEN g > 0 THEN 1.0 / (g * g) ELSE 0.0 END AS w,
                 CASE WHEN a.p[a.time + 1] > b.p[a.time + 1] THEN 1.0
                      WHEN a.p[a.time + 1] = b.p[a.time + 1] THEN 0.5 ELSE 0.0 END AS won
          FROM s a JOIN s b ON a.replicate = b.replicate AND a.event = 1 AND a.time < b.time
          JOIN km ON km.time = a.time)
        SELECT replicate, round(sum(w * won) / sum(w), 9) AS c_index FROM pairs GROUP BY 1""",
)
def bootstrap_c_index_query(spark, sf_dir):
    """The concordance of each replicate, compared with a statement that forms all pairs."""
    values = bootstrap_exact(
        cohort(spark, sf_dir), "pid", SCORES, "years_to_event", "event", PAIR_REPLICATES, with_c_index=True
    )
    c = values.filter("metric = 'c_index'")
    return c.select("replicate", rounded("value", 9, "c_index"))


@query("bootstrap_cells")
def bootstrap_cells_query(spark, sf_dir):
    """The form for large tables: draws counts of cells, so only its distribution is fixed."""
    values = bootstrap_cells(flagged(spark, sf_dir), "fine_score", "label", CELL_REPLICATES, by=["arm"])
    return metric_ci(values, ["arm", "metric"])


def mixed_sql(x: str, name: str) -> str:
    """Select items, each using the one before, that end in the 32-bit hash ``name`` of ``x``."""
    steps = [f"({x})::UBIGINT AS {name}_0"]
    for i, (shift, factor) in enumerate(ROUNDS):
        steps.append(f"(xor({name}_{i}, {name}_{i} >> {shift}) * {factor}::UBIGINT) & 4294967295::UBIGINT AS {name}_{i + 1}")
    return ", ".join([*steps, f"xor({name}_{len(ROUNDS)}, {name}_{len(ROUNDS)} >> {LAST_SHIFT}) AS {name}"])


def joint_draws_sql(source: str, key: str, replicates: int, seed: int = 42) -> str:
    """CTEs ``numbered`` and ``weights``: how often each replicate draws each row of ``source``."""
    start = int(mix(np.array([seed], np.uint32))[0])
    terms = ["1.0"]
    for k in range(1, MOST):
        terms.append(terms[-1] + f" * mean / {k}")
    limits = ", ".join(f"floor(exp(-mean) * ({' + '.join(terms[: k + 1])}) * 4294967296)::UBIGINT AS t{k}" for k in range(MOST))
    reached = " + ".join(f"(u >= t{k})::INTEGER" for k in range(MOST))
    return f"""
numbered AS (SELECT *, row_number() OVER (ORDER BY {key}) - 1 AS idx FROM {source} WHERE {key} IS NOT NULL),
size AS (SELECT count(*) AS n, greatest(0.0, 1 - {MARGIN} / sqrt(count(*))) AS mean FROM numbered),
limits AS (SELECT n, {limits} FROM size),
replicates AS (SELECT b, {mixed_sql(f"(b + {start}) & 4294967295", "part")} FROM range({replicates}) t(b)),
places AS (SELECT idx, {mixed_sql("idx", "base")} FROM numbered),
counted AS (
  SELECT b, idx, {mixed_sql("(base + part) & 4294967295::UBIGINT", "u")}, {reached} AS drawn
  FROM places, replicates, limits),
lacking AS (SELECT b, unnest(range((SELECT n FROM size) - sum(drawn)::BIGINT)) AS j FROM counted GROUP BY b),
completing AS (
  SELECT b, ('0x' || substr(md5('{seed}-' || b || '-' || j), 1, 8))::BIGINT % (SELECT n FROM size) AS idx FROM lacking),
weights AS (
  SELECT CAST(b AS INTEGER) AS replicate, idx, sum(drawn) AS w FROM (
    SELECT b, idx, drawn FROM counted WHERE drawn > 0 UNION ALL SELECT b, idx, 1 FROM completing)
  GROUP BY ALL)"""


JOINT_SQL = f"""WITH {YEARLY_SQL}, {CENSORING_SQL.removeprefix(COHORT_SQL + ",").strip()},
{joint_draws_sql('cohort', 'pid', JOINT_REPLICATES)},
cells AS (
  SELECT replicate, year, score AS threshold, coalesce(sum(w) FILTER (label = 1), 0)::DOUBLE AS pos,
         coalesce(sum(w) FILTER (label = 0), 0)::DOUBLE AS neg
  FROM weights JOIN numbered USING (idx) JOIN yearly ON numbered.pid = yearly.pid
  WHERE label IS NOT NULL GROUP BY ALL),
pts AS (
  SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM cells
  WINDOW w AS (PARTITION BY replicate, year ORDER BY threshold DESC)),
areas AS (
  SELECT replicate, year, sum(pos) AS n_pos, sum(neg) AS n_neg, sum(neg * (tp - pos / 2)) AS won,
         sum(pos * tp / (tp + fp)) AS steps,
         sum(pos * (tp / (tp + fp) + CASE WHEN tp + fp > pos + neg THEN (tp - pos) / (tp + fp - pos - neg) ELSE 1 END) / 2) AS area
  FROM pts GROUP BY ALL HAVING sum(pos) > 0 AND sum(neg) > 0),
pairs AS (
  SELECT replicate, t, score, coalesce(sum(w) FILTER (event = 1 AND time = t), 0)::DOUBLE AS former,
         coalesce(sum(w) FILTER (time > t), 0)::DOUBLE AS latter
  FROM weights JOIN (
    SELECT idx, event, years_to_event AS time, unnest([{', '.join(SCORES)}]) AS score,
           unnest(range({len(SCORES)})) AS t FROM numbered) USING (idx)
  WHERE time > t OR event = 1 AND time = t GROUP BY ALL),
summed AS (SELECT *, sum(former) OVER (PARTITION BY replicate, t ORDER BY score DESC) AS above FROM pairs),
by_year AS (
  SELECT replicate, t, sum(latter * (above - former / 2)) AS won, sum(former) * sum(latter) AS n_pairs
  FROM summed GROUP BY ALL),
indexes AS (
  SELECT replicate, sum(won / (g * g)) / sum(n_pairs / (g * g)) AS c
  FROM by_year JOIN km ON km.time = t WHERE g > 0 GROUP BY 1 HAVING sum(n_pairs) > 0),
tidy AS (
  SELECT year, 'auroc' AS metric, won / (n_pos * n_neg) AS value FROM areas
  UNION ALL SELECT year, 'auprc', area / n_pos FROM areas
  UNION ALL SELECT year, 'average_precision', steps / n_pos FROM areas
  UNION ALL SELECT NULL, 'c_index', c FROM indexes)"""


@query(
    "bootstrap_joint",
    JOINT_SQL + f" SELECT CAST(year AS INTEGER) AS year, metric, {INTERVAL_SQL} FROM tidy GROUP BY 1, 2",
)
def bootstrap_joint_query(spark, sf_dir):
    """Intervals of all yearly metrics and the C-index from one draw of whole cases, by the same hashes on both sides."""
    values = bootstrap_joint(cohort(spark, sf_dir), "pid", SCORES, "years_to_event", "event", JOINT_REPLICATES)
    return metric_ci(values).withColumns({c: F.round(c, 9) for c in ("mean", "lower_bound", "upper_bound")})


def renamed(sql: str) -> str:
    """CTEs under other names, to stand beside those of a bootstrap."""
    for name in ("cells", "pts", "lagged", "areas"):
        sql = sql.replace(name, f"{name}2")
    return sql


@query(
    "evaluate_cohort",
    JOINT_SQL
    + f""",
{renamed(points_sql('yearly', 'year'))}, {renamed(areas_sql('year'))},
once AS (SELECT * FROM {renamed(TIDY_SQL)}),
ci AS (SELECT year, metric, {INTERVAL_SQL} FROM tidy GROUP BY 1, 2)
SELECT year, metric, round(value, 6) AS value, round(mean, 6) AS mean,
       round(lower_bound, 6) AS lower_bound, round(upper_bound, 6) AS upper_bound
FROM once JOIN ci USING (year, metric)""",
)
def evaluate_cohort_query(spark, sf_dir):
    """The whole evaluation's metrics beside their intervals."""
    tables = evaluate_cohort(cohort(spark, sf_dir), "pid", SCORES, n_replicates=JOINT_REPLICATES)
    both = tables["metrics"].join(tables["intervals"], ["year", "metric"])
    numbers = ("value", "mean", "lower_bound", "upper_bound")
    return both.select("year", "metric", *[rounded(c, 6) for c in numbers])


# --- rank tests -------------------------------------------------------------------------------

MANN_WHITNEY_SQL = """
WITH pair AS (
  SELECT o AS dataset, value, CAST(event_type = 'click' AS INTEGER) AS is_base
  FROM events, (SELECT DISTINCT event_type AS o FROM events WHERE event_type <> 'click')
  WHERE event_type IN (o, 'click')),
ranked AS (
  SELECT dataset, value, is_base, row_number() OVER (PARTITION BY dataset ORDER BY value) AS rn FROM pair),
ties AS (
  SELECT dataset, value, avg(rn) AS r, count(*) AS t, count(*) FILTER (is_base = 1) AS b
  FROM ranked GROUP BY 1, 2),
s AS (
  SELECT dataset, CAST(sum(b) AS BIGINT) AS n1, CAST(sum(t - b) AS BIGINT) AS n2,
         sum(b * r) - sum(b) * (sum(b) + 1) / 2 AS u,
         sum(t::DOUBLE * t * t - t) AS tie FROM ties GROUP BY 1),
z AS (
  SELECT *, greatest(abs(u - n1 * n2 / 2) - 0.5, 0) / sqrt(n1 * n2 / 12.0 * (n1 + n2 + 1
         - tie / ((n1 + n2) * (n1 + n2 - 1.0)))) AS z FROM s),
e AS (SELECT *, z / sqrt(2.0) AS x, 1 / (1 + 0.3275911 * z / sqrt(2.0)) AS k FROM z),
p AS (
  SELECT *, least((((((1.061405429 * k - 1.453152027) * k) + 1.421413741) * k - 0.284496736) * k
         + 0.254829592) * k * exp(-x * x), 1.0) AS p FROM e)"""


@query(
    "mann_whitney",
    MANN_WHITNEY_SQL
    + """ SELECT dataset AS event_type, n1 AS n_baseline, n2 AS n_other, u, round(z, 9) AS z,
          round(p, 9) AS p_value FROM p""",
)
def mann_whitney_query(spark, sf_dir):
    tests = mann_whitney(table(spark, sf_dir, "events"), "value", "event_type", "click")
    return tests.withColumns({c: F.round(c, 9) for c in ("z", "p_value")})


@query(
    "bonferroni",
    MANN_WHITNEY_SQL
    + """ SELECT dataset AS event_type, round(p, 9) AS p_value,
          round(least(p * count(*) OVER (), 1.0), 9) AS adjusted_p_value FROM p""",
)
def bonferroni_query(spark, sf_dir):
    tests = mann_whitney(table(spark, sf_dir, "events"), "value", "event_type", "click")
    return bonferroni(tests).select("event_type", rounded("p_value"), rounded("adjusted_p_value"))


# --- scoring ----------------------------------------------------------------------------------


def linear_model():
    """A stand-in model: six linear functions of the 64 features."""
    position = np.arange(64)
    weights = np.stack([(position % 7 - 3) / 10.0 + year * 0.01 for year in range(6)], axis=1)

    def predict(batch):
        return np.stack(batch["embedding"].to_numpy()).astype(float) @ weights

    return predict


def linear_model_with_features():
    predict = linear_model()

    def both(batch):
        vectors = np.stack(batch["embedding"].to_numpy()).astype(float)
        return predict(batch), vectors * 2.0

    return both


SCORED_SQL = "SELECT vec_id, " + ", ".join(
    f"""round(list_sum(list_transform(range(64), lambda i:
        CAST(embedding[i + 1] AS DOUBLE) * ((i % 7 - 3) / 10.0 + {year} * 0.01))), 6) AS {s}"""
    for year, s in enumerate(SCORES)
)


def rounded_scores():
    return [rounded(s, 6) for s in SCORES]


@query("score_cases", SCORED_SQL + " FROM embeddings")
def score_cases_query(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return score_cases(vectors, linear_model).select("vec_id", *rounded_scores())


@query(
    "score_with_features",
    SCORED_SQL
    + "".join(f", round(2 * CAST(embedding[{i + 1}] AS DOUBLE), 6) AS feature_{i}" for i in range(64))
    + ", 64 AS width FROM embeddings",
)
def score_with_features_query(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    scored = score_with_features(vectors, linear_model_with_features)
    return scored.select(
        "vec_id",
        *rounded_scores(),
        *[rounded(F.get("features", F.lit(i)), 6, f"feature_{i}") for i in range(64)],
        F.size("features").alias("width"),
    )


@query("score_resume", SCORED_SQL + """
    , round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS feature_sum FROM embeddings""")
def score_resume_query(spark, sf_dir):
    """An interrupted run left some labels scored; the second run does the rest, each case once.

    Scores and features are stored together.
    """
    done, model = scratch_dir(spark, "scored"), linear_model_with_features
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    score_resume(vectors.filter("label < 4"), done, "vec_id", model, features=True)
    finished = score_resume(vectors, done, "vec_id", model, n_chunks=2, features=True)
    total = F.aggregate("features", F.lit(0.0), lambda a, f: a + f)
    return finished.select("vec_id", *rounded_scores(), F.round(total / 2, 6).alias("feature_sum"))


@query(
    "unscored",
    "SELECT vec_id, label FROM embeddings WHERE label >= 4",
)
def unscored_query(spark, sf_dir):
    """Rows whose score column is still empty."""
    partly = table(spark, sf_dir, "embeddings").select(
        "vec_id",
        "label",
        F.when(F.col("label") < 4, F.get("embedding", F.lit(0)).cast("double")).alias("pred_risk_year_0"),
    )
    return unscored(partly).drop("pred_risk_year_0")
