"""The table functions that SQL callers use, each called through ``spark.sql``."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortscope.plans.sql_functions import create_dataset_functions, create_ranking_functions, create_survival_functions
from workload.base import COHORT_SQL, CUTOFF, FLAGGED_SQL, SCORES, cohort, flagged, query, rounded, table
from workload.evaluation import CENSORING_SQL, MANN_WHITNEY_SQL, TIDY_SQL, YEARLY_SQL, areas_sql, points_sql


def _ranking(spark, sf_dir):
    flagged(spark, sf_dir).createOrReplaceTempView("flagged_lines")
    create_ranking_functions(spark, "lines", "flagged_lines", "fine_score", "label", by=["arm"])


def _survival(spark, sf_dir):
    cohort(spark, sf_dir).createOrReplaceTempView("scored_cohort")
    create_survival_functions(spark, "trial", "scored_cohort", SCORES, "years_to_event", "event")


def _datasets(spark, sf_dir):
    table(spark, sf_dir, "events").createOrReplaceTempView("all_events")
    create_dataset_functions(spark, "events", "all_events", "value", "event_type")


@query(
    "sql_auroc",
    f"""WITH {FLAGGED_SQL}, {points_sql('flagged', 'arm', 'fine_score')}, {areas_sql('arm')}
        SELECT arm, CAST(n_pos AS BIGINT) AS n_pos, CAST(n_neg AS BIGINT) AS n_neg, round(auroc, 9) AS auroc,
               round(auprc, 9) AS auprc, round(average_precision, 9) AS average_precision
        FROM areas""",
)
def sql_auroc_query(spark, sf_dir):
    """Areas under both curves per group, from SQL."""
    _ranking(spark, sf_dir)
    found = spark.sql("SELECT * FROM lines_auroc()")
    return found.select("arm", "n_pos", "n_neg", *[rounded(c) for c in ("auroc", "auprc", "average_precision")])


@query(
    "sql_confusion",
    f"""WITH {FLAGGED_SQL}, cuts AS (SELECT unnest([1000.0, 20000.0, 50000.0]::DOUBLE[]) AS cutoff)
        SELECT cutoff, arm, count(*) FILTER (label = 1 AND fine_score >= cutoff) AS tp,
               count(*) FILTER (label = 0 AND fine_score >= cutoff) AS fp,
               count(*) FILTER (label = 1 AND fine_score < cutoff) AS fn,
               count(*) FILTER (label = 0 AND fine_score < cutoff) AS tn
        FROM flagged, cuts GROUP BY 1, 2""",
)
def sql_confusion_query(spark, sf_dir):
    """Confusion counts at several cutoffs: the function is called once per row beside it."""
    _ranking(spark, sf_dir)
    return spark.sql("SELECT * FROM VALUES (1000.0D), (20000.0D), (50000.0D) AS cuts(cutoff), LATERAL lines_confusion(cutoff)")


@query(
    "sql_youden",
    f"""WITH {FLAGGED_SQL}, {points_sql('flagged', 'arm', 'fine_score')}
        SELECT arm, threshold, round(tp / n_pos - fp / n_neg, 9) AS youden FROM pts
        QUALIFY row_number() OVER (PARTITION BY arm ORDER BY round(tp / n_pos - fp / n_neg, 12) DESC, threshold DESC) = 1""",
)
def sql_youden_query(spark, sf_dir):
    _ranking(spark, sf_dir)
    return spark.sql("SELECT arm, threshold, round(youden, 9) AS youden FROM lines_youden()")


@query(
    "sql_censoring_distribution",
    f"WITH {CENSORING_SQL} SELECT time, n_at_risk, n_censored, round(g, 9) AS g FROM km",
)
def sql_censoring_distribution_query(spark, sf_dir):
    """Kaplan-Meier survival of the censoring times, from SQL."""
    _survival(spark, sf_dir)
    return spark.sql("SELECT time, n_at_risk, n_censored, round(g, 9) AS g FROM trial_censoring_distribution()")


@query(
    "sql_yearly_auroc",
    f"""WITH {YEARLY_SQL}, {points_sql('yearly', 'year')}, {areas_sql('year')}
        SELECT year, metric, round(value, 9) AS value FROM {TIDY_SQL}""",
)
def sql_yearly_auroc_query(spark, sf_dir):
    _survival(spark, sf_dir)
    wide = spark.sql("SELECT year, auroc, auprc, average_precision FROM trial_yearly_auroc()")
    return wide.unpivot("year", ["auroc", "auprc", "average_precision"], "metric", "value").withColumn("value", F.round("value", 9))


@query(
    "sql_concordance_index",
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
def sql_concordance_index_query(spark, sf_dir):
    """From SQL, compared with a statement that forms all pairs."""
    _survival(spark, sf_dir)
    return spark.sql("SELECT n_pairs, round(c_index, 9) AS c_index FROM trial_concordance_index()")


@query(
    "sql_mann_whitney",
    MANN_WHITNEY_SQL
    + """ SELECT dataset AS event_type, n1 AS n_baseline, n2 AS n_other, round(u, 6) AS u, round(z, 6) AS z,
                 round(p, 6) AS p_value FROM p""",
)
def sql_mann_whitney_query(spark, sf_dir):
    """Every other dataset against the one that the caller names, from SQL."""
    _datasets(spark, sf_dir)
    found = spark.sql("SELECT * FROM events_mann_whitney(baseline => 'click')")
    return found.select("event_type", "n_baseline", "n_other", *[rounded(c, 6) for c in ("u", "z", "p_value")])


@query(
    "sql_mean_ci",
    """SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean,
              round(quantile_cont(value, 0.05), 9) AS lower_bound, round(quantile_cont(value, 0.975), 9) AS upper_bound
       FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL GROUP BY 1""",
)
def sql_mean_ci_query(spark, sf_dir):
    """One bound given, the other left at what the function says."""
    _datasets(spark, sf_dir)
    found = spark.sql("SELECT * FROM events_mean_ci(lower => 0.05)")
    return found.select("event_type", "n", rounded("mean", 6), rounded("lower_bound"), rounded("upper_bound"))
