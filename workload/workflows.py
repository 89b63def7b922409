"""Whole label and path workflows over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortscope.operators.profiles import five_number_summary
from cohortscope.operators.rank_tests import bonferroni, mann_whitney
from cohortscope.plans.labels import (
    annotation_labels,
    cases_with_outcome,
    corrected_paths,
    nodule_slices,
)
from workload.base import SCANS_SQL, folders, query, scans, table
from workload.evaluation import MANN_WHITNEY_SQL


@query(
    "annotation_labels",
    """WITH a AS (
         SELECT l_orderkey AS id, l_returnflag AS kind, coalesce(CASE WHEN l_tax > 0 THEN l_linenumber END, 0)::DOUBLE
                  AS grade, l_linenumber, l_partkey, l_suppkey FROM lineitem),
       r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY grade DESC, l_linenumber, l_partkey, l_suppkey)
               AS rn FROM a)
       SELECT id, grade, kind, CASE WHEN kind = 'R' AND grade > 3 THEN 1 ELSE 0 END AS event,
              '/data/scan-' || CASE WHEN id < 10000 THEN lpad(id::VARCHAR, 4, '0') ELSE id::VARCHAR END || '.mhd' AS mhd_path,
              '/data/scan-' || CASE WHEN id < 10000 THEN lpad(id::VARCHAR, 4, '0') ELSE id::VARCHAR END || '.raw' AS raw_path
       FROM r WHERE rn = 1""",
)
def annotation_labels_query(spark, sf_dir):
    """The most malignant annotation per scan; a third of the grades is missing."""
    annotations = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        F.col("l_returnflag").alias("kind"),
        F.when(F.col("l_tax") > 0, F.col("l_linenumber")).cast("string").alias("grade"),
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
    )
    return annotation_labels(
        annotations,
        "/data",
        "scan-",
        ["l_linenumber", "l_partkey", "l_suppkey"],
        key="id",
        kind="kind",
        grade="grade",
        nodule="R",
    )


@query(
    "nodule_slices",
    f"""WITH {SCANS_SQL},
        f AS (SELECT regexp_replace(path, '/[^/]*/[^/]*$', '') AS folder, count(*) AS n FROM scans GROUP BY 1),
        cases AS (
          SELECT o_orderkey, '/archive/' || o_custkey || '/' || strftime(o_orderdate, '%m-%d-%Y') || '-A-'
                 || o_orderkey AS folder FROM orders)
        SELECT o_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(n - l_linenumber AS INTEGER) AS nodule_slice,
               CAST(l_partkey AS DOUBLE) AS x, CAST(l_suppkey AS DOUBLE) AS y
        FROM cases JOIN lineitem ON o_orderkey = l_orderkey LEFT JOIN f USING (folder)""",
)
def nodule_slices_query(spark, sf_dir):
    """Order lines as nodules of their order; ids differ in case, positions are ``x, y`` texts."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    folder = F.concat(
        F.lit("/archive/"), "o_custkey", F.lit("/"), F.date_format("o_orderdate", "MM-dd-yyyy"), F.lit("-A-"), "o_orderkey"
    )
    cases = orders.select(
        "o_orderkey", F.concat(F.lit("Case-"), "o_orderkey").alias("pid"), folder.alias("Directory")
    )
    nodules = lines.select(
        F.concat(F.lit("CASE-"), "l_orderkey").alias("pid"),
        F.concat_ws(", ", "l_partkey", "l_suppkey").alias("position"),
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
    )
    files = scans(spark, sf_dir).select(F.regexp_replace("path", "/[^/]*$", "").alias("path"))
    found = nodule_slices(cases, nodules, files, position="position", image="l_linenumber")
    return found.select("o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "nodule_slice", "x", "y")


def outcome_inputs(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    diagnoses = customers.filter("c_custkey % 7 <> 0").select(
        F.col("c_custkey").alias("patient_id"),
        (F.col("c_acctbal") < 0).cast("int").alias("lung_cancer"),
        F.col("c_nationkey").alias("event_1"),
    )
    cases = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("pid"), "o_orderkey")
    wanted = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("pid"))
    return cases_with_outcome(cases, diagnoses.unionAll(diagnoses), wanted)


@query(
    "cases_with_outcome",
    """SELECT o_custkey AS pid, o_orderkey, CAST(c_acctbal < 0 AS INTEGER) AS lung_cancer, c_nationkey AS event_1
       FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 7 <> 0) ON o_custkey = c_custkey
       WHERE o_custkey IN (SELECT doc_id FROM labels)""",
)
def cases_with_outcome_query(spark, sf_dir):
    """Wanted cases with the outcome from a diagnosis table that repeats its rows."""
    return outcome_inputs(spark, sf_dir)[0]


@query(
    "cases_without_diagnosis",
    """SELECT doc_id AS pid FROM labels
       WHERE doc_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0)""",
)
def cases_without_diagnosis_query(spark, sf_dir):
    return outcome_inputs(spark, sf_dir)[1]


@query(
    "corrected_paths",
    f"""WITH {SCANS_SQL},
        catalog AS (
          SELECT DISTINCT pid, split_part(path, '/', 4) AS study, split_part(path, '/', 5) AS series,
                 regexp_replace(path, '/[^/]*$', '') AS folder FROM scans),
        cases AS (
          SELECT o_orderkey, o_custkey AS pid, CAST(o_orderkey AS VARCHAR) AS study_token,
                 CAST(o_orderkey % 90 AS VARCHAR) AS series_token FROM orders)
        SELECT o_orderkey, c.pid, CASE WHEN o_orderkey % 2 = 0 THEN '/ok/' || o_orderkey ELSE min(folder) END
               AS "Directory"
        FROM cases c LEFT JOIN catalog k ON o_orderkey % 2 = 1 AND c.pid = k.pid
          AND contains(k.study, c.study_token) AND contains(k.series, c.series_token)
        GROUP BY o_orderkey, c.pid""",
)
def corrected_paths_query(spark, sf_dir):
    """Odd orders carry outdated folders whose last tokens are still right."""
    orders = table(spark, sf_dir, "orders")
    old = F.concat(
        F.lit("/old/01-01-1999-B-"), "o_orderkey", F.lit("/9.0-X-"), F.col("o_orderkey") % 90
    )
    columns = ["o_orderkey", F.col("o_custkey").alias("pid")]
    incorrect = orders.filter("o_orderkey % 2 = 1").select(*columns, old.alias("Directory"))
    correct = orders.filter("o_orderkey % 2 = 0").select(
        *columns, F.concat(F.lit("/ok/"), "o_orderkey").alias("Directory")
    )
    return corrected_paths(incorrect, correct, folders(spark, sf_dir))


@query(
    "distribution_comparison",
    MANN_WHITNEY_SQL.replace("'click'", "'view'")
    + """, q AS (
         SELECT event_type, quantile_cont(value, 0.25) AS q1, median(value) AS med,
                quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1),
       w AS (
         SELECT e.event_type, min(value) AS whisker_low, max(value) AS whisker_high FROM events e JOIN q
         ON e.event_type = q.event_type AND value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)
         GROUP BY 1)
       SELECT q.event_type, round(q1, 9) AS q1, round(med, 9) AS median, round(q3, 9) AS q3,
              whisker_low, whisker_high, u, round(z, 9) AS z, round(p, 9) AS p_value,
              round(CASE WHEN p IS NOT NULL THEN least(p * (SELECT count(*) FROM p), 1.0) END, 9) AS adjusted_p_value
       FROM q JOIN w ON q.event_type = w.event_type LEFT JOIN p ON q.event_type = dataset""",
)
def distribution_comparison_query(spark, sf_dir):
    """Box plots beside the rank test of every dataset against one baseline."""
    events = table(spark, sf_dir, "events")
    boxes = five_number_summary(events, "value", ["event_type"])
    tests = bonferroni(mann_whitney(events, "value", "event_type", "view"))
    exact = ("whisker_low", "whisker_high", "u")
    inexact = ("q1", "median", "q3", "z", "p_value", "adjusted_p_value")
    return boxes.join(tests, "event_type", "left").select(
        "event_type", *exact, *[F.round(c, 9).alias(c) for c in inexact]
    )
