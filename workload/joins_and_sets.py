"""Joins, set operations and sorting."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortscope.functions.survival import lookup_by_timepoint
from cohortscope.operators.groups import first_per_group
from cohortscope.operators.joins import (
    anti_by_key,
    join_ci,
    join_clinical,
    join_outcome,
    join_suffixed,
    missing_keys,
    resolve_by_accession,
    resolve_by_suffix,
    semi_by_key,
)
from cohortscope.operators.selection import priority_tiers, stack_datasets
from workload.base import CLINICAL_SQL, SCANS_SQL, clinical, folders, query, scans, table


@query(
    "join_clinical",
    f"""WITH {SCANS_SQL}, {CLINICAL_SQL}
        SELECT s.pid, scan, position, part, scan_year, scr_days0, candx_days, fup_days, conflc
        FROM scans s LEFT JOIN clinical c ON s.pid = c.pid""",
)
def join_clinical_query(spark, sf_dir):
    cases = scans(spark, sf_dir).select("pid", "scan", "position", "part", "scan_year")
    facts = clinical(spark, sf_dir).select("pid", "scr_days0", "candx_days", "fup_days", "conflc")
    return join_clinical(cases, facts)


@query(
    "join_outcome",
    """SELECT o_orderkey, o_custkey, c_acctbal, c_mktsegment
       FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
)
def join_outcome_query(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer")
    return join_outcome(orders, customers, "o_custkey", "c_custkey", ["c_acctbal", "c_mktsegment"])


@query(
    "join_suffixed",
    """SELECT a.o_custkey, a.o_orderkey AS o_orderkey_x, a.o_totalprice AS o_totalprice_x,
              b.o_orderkey AS o_orderkey_y, b.o_totalprice AS o_totalprice_y, b.n_orders
       FROM orders a LEFT JOIN (
         SELECT o_custkey, min(o_orderkey) AS o_orderkey, max(o_totalprice) AS o_totalprice,
                count(*) AS n_orders
         FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) b ON a.o_custkey = b.o_custkey""",
)
def join_suffixed_query(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    right = (
        orders.filter("o_orderstatus = 'F'")
        .groupBy("o_custkey")
        .agg(
            F.min("o_orderkey").alias("o_orderkey"),
            F.max("o_totalprice").alias("o_totalprice"),
            F.count(F.lit(1)).alias("n_orders"),
        )
    )
    left = orders.select("o_custkey", "o_orderkey", "o_totalprice")
    return join_suffixed(left, right, "o_custkey")


@query(
    "semi_by_key",
    """SELECT c_custkey, c_name FROM customer WHERE EXISTS (
         SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 480000)""",
)
def semi_by_key_query(spark, sf_dir):
    large = table(spark, sf_dir, "orders").filter("o_totalprice > 480000")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return semi_by_key(customers, large, "c_custkey", "o_custkey")


@query(
    "anti_by_key",
    """SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (
         SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 480000)""",
)
def anti_by_key_query(spark, sf_dir):
    large = table(spark, sf_dir, "orders").filter("o_totalprice > 480000")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return anti_by_key(customers, large, "c_custkey", "o_custkey")


@query(
    "missing_keys",
    "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def missing_keys_query(spark, sf_dir):
    return missing_keys(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id"
    )


@query(
    "complement_by_key",
    """SELECT * FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""",
)
def complement_by_key_query(spark, sf_dir):
    """Records of subjects that were not selected."""
    labels = table(spark, sf_dir, "labels")
    return anti_by_key(labels, labels.filter("quality = 1"), "doc_id")


@query(
    "join_ci",
    """SELECT s_suppkey, a.name AS name, r_name, n_regionkey
       FROM (SELECT s_suppkey, lower(n_name) AS name, n_regionkey FROM supplier
             JOIN nation ON s_nationkey = n_nationkey) a
       JOIN (SELECT upper(n_name) AS loud, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) b
         ON lower(a.name) = lower(b.loud)""",
)
def join_ci_query(spark, sf_dir):
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    suppliers = table(spark, sf_dir, "supplier")
    left = suppliers.join(nations, suppliers.s_nationkey == nations.n_nationkey).select(
        "s_suppkey", F.lower("n_name").alias("name"), "n_regionkey"
    )
    right = nations.join(regions, nations.n_regionkey == regions.r_regionkey).select(
        F.upper("n_name").alias("loud"), "r_name"
    )
    return join_ci(left, right, "name", "loud").drop("loud")


@query(
    "resolve_by_accession",
    f"""WITH {SCANS_SQL}
        SELECT o_custkey AS pid, o_orderkey AS scan,
               (SELECT min(path) FROM scans s WHERE s.pid = o_custkey AND s.scan = o_orderkey)
                 AS resolved_path
        FROM orders""",
)
def resolve_by_accession_query(spark, sf_dir):
    """Orders without lines find no path."""
    cases = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("pid"), F.col("o_orderkey").alias("scan")
    )
    return resolve_by_accession(cases, scans(spark, sf_dir), ["pid", "scan"])


RESOLVE_SQL = f"""
WITH {SCANS_SQL},
catalog AS (
  SELECT DISTINCT pid, split_part(path, '/', 4) AS study, split_part(path, '/', 5) AS series,
         regexp_replace(path, '/[^/]*$', '') AS folder FROM scans),
cases AS (
  SELECT o_orderkey, o_custkey AS pid, CAST(year(o_orderdate) AS VARCHAR) AS time_suffix,
         CAST(o_orderkey % 90 AS VARCHAR) AS series_suffix FROM orders)
SELECT o_orderkey, c.pid, time_suffix, series_suffix, min(folder) AS resolved_path,
       count(folder) AS n_matches,
       CASE count(folder) WHEN 0 THEN 'none' WHEN 1 THEN 'unique' ELSE 'multiple' END AS match_status
FROM cases c LEFT JOIN catalog k
  ON c.pid = k.pid AND contains(k.study, c.time_suffix) AND contains(k.series, c.series_suffix)
GROUP BY ALL"""


@query("resolve_by_suffix", RESOLVE_SQL)
def resolve_by_suffix_query(spark, sf_dir):
    """Folders of the same subject whose study and series names contain two fragments."""
    cases = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.col("o_custkey").alias("pid"),
        F.year("o_orderdate").cast("string").alias("time_suffix"),
        (F.col("o_orderkey") % 90).cast("string").alias("series_suffix"),
    )
    return resolve_by_suffix(
        cases, folders(spark, sf_dir), "pid", ("time_suffix", "study"), ("series_suffix", "series")
    )


@query(
    "lookup_by_timepoint",
    f"""WITH {CLINICAL_SQL}
        SELECT o_orderkey, year(o_orderdate) - 1996 AS timepoint,
               CASE year(o_orderdate) WHEN 1996 THEN scr_days0 WHEN 1997 THEN scr_days1
                 WHEN 1998 THEN scr_days2 END AS days
        FROM orders LEFT JOIN clinical ON o_custkey = pid""",
)
def lookup_by_timepoint_query(spark, sf_dir):
    """Timepoints before the first or after the last column give NULL."""
    orders = table(spark, sf_dir, "orders")
    joined = join_clinical(orders.withColumn("pid", F.col("o_custkey")), clinical(spark, sf_dir))
    timepoint = F.year("o_orderdate") - 1996
    days = lookup_by_timepoint([F.col(f"scr_days{i}") for i in range(3)], timepoint)
    return joined.select("o_orderkey", timepoint.alias("timepoint"), days.alias("days"))


# --- set operations ---------------------------------------------------------------------------


@query(
    "concat_rows",
    """SELECT n_nationkey AS key, n_name AS name FROM nation
       UNION ALL SELECT s_suppkey, s_name FROM supplier
       UNION ALL SELECT c_custkey, c_name FROM customer""",
)
def concat_rows_query(spark, sf_dir):
    parts = [
        table(spark, sf_dir, name).select(F.col(key).cast("long").alias("key"), F.col(text).alias("name"))
        for name, key, text in (
            ("nation", "n_nationkey", "n_name"),
            ("supplier", "s_suppkey", "s_name"),
            ("customer", "c_custkey", "c_name"),
        )
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "stack_datasets",
    """SELECT 'labels' AS dataset_name, doc_id, quality, CAST(NULL AS VARCHAR) AS lang FROM labels
       UNION ALL SELECT 'documents', doc_id, NULL, lang FROM documents""",
)
def stack_datasets_query(spark, sf_dir):
    return stack_datasets(
        {
            "labels": table(spark, sf_dir, "labels").select("doc_id", "quality"),
            "documents": table(spark, sf_dir, "documents").select("doc_id", "lang"),
        }
    )


TIERS_SQL = f"""
WITH {SCANS_SQL},
tiered AS (
  SELECT pid, scan, position, part, path, thickness, kernel, plane,
         CASE WHEN thickness = 25 AND kernel = 'A' AND plane = 'F' THEN 1
              WHEN thickness = 20 AND kernel = 'R' AND plane = 'F' THEN 2
              WHEN thickness = 20 AND kernel = 'N' AND plane = 'F' THEN 3
              WHEN thickness = 12 AND kernel = 'A' AND plane = 'F' THEN 4
              WHEN thickness = 32 AND kernel = 'R' AND plane = 'F' THEN 5
              WHEN part % 211 = 0 THEN 6 END AS tier
  FROM scans),
batched AS (
  SELECT *, CASE WHEN tier <= 2 THEN 1 ELSE tier - 1 END AS batch FROM tiered WHERE tier IS NOT NULL),
kept AS (SELECT *, min(batch) OVER (PARTITION BY pid) AS best FROM batched)"""


def tiered_scans(spark, sf_dir):
    rules = [
        (batch, (F.col("thickness") == t) & (F.col("kernel") == k) & (F.col("plane") == "F"))
        for batch, t, k in ((1, 25, "A"), (1, 20, "R"), (2, 20, "N"), (3, 12, "A"), (4, 32, "R"))
    ]
    columns = ["pid", "scan", "position", "part", "path", "thickness", "kernel", "plane"]
    cases = scans(spark, sf_dir).select(*columns)
    return priority_tiers(cases, "pid", rules, include=F.col("part") % 211 == 0)


@query(
    "priority_tiers",
    TIERS_SQL
    + " SELECT pid, scan, position, part, path, thickness, kernel, plane, tier FROM kept WHERE batch = best",
)
def priority_tiers_query(spark, sf_dir):
    """Ordered acquisition rules, later ones only for subjects still without a scan."""
    return tiered_scans(spark, sf_dir)


@query(
    "baseline_selection",
    TIERS_SQL
    + """ SELECT pid, scan, position, part, path, tier FROM (
            SELECT *, row_number() OVER (PARTITION BY pid ORDER BY tier, path, scan, position, part) AS rn
            FROM kept WHERE batch = best) WHERE rn = 1""",
)
def baseline_selection_query(spark, sf_dir):
    """One scan per subject: the first in rule and path order."""
    chosen = tiered_scans(spark, sf_dir).select("pid", "scan", "position", "part", "path", "tier")
    return first_per_group(chosen, ["pid"], ["tier", "path"])


# --- sorting ----------------------------------------------------------------------------------


@query(
    "sort_multi",
    "SELECT o_custkey, o_orderdate, o_totalprice, o_orderkey FROM orders ORDER BY 1, 2, 3",
)
def sort_multi_query(spark, sf_dir):
    columns = ["o_custkey", "o_orderdate", "o_totalprice"]
    return table(spark, sf_dir, "orders").select(*columns, "o_orderkey").orderBy(*columns)


@query(
    "sort_desc",
    "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey",
)
def sort_desc_query(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "o_custkey")


@query(
    "nth_row",
    """SELECT o_orderkey, o_totalprice FROM orders
       ORDER BY o_totalprice DESC, o_orderkey LIMIT 1 OFFSET 9""",
)
def nth_row_query(spark, sf_dir):
    """The row in tenth place."""
    ordered = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return ordered.orderBy(F.desc("o_totalprice"), "o_orderkey").offset(9).limit(1)


@query("path_sort", f"WITH {SCANS_SQL} SELECT path FROM scans ORDER BY path")
def path_sort_query(spark, sf_dir):
    return scans(spark, sf_dir).select("path").orderBy("path")
