"""Aggregations, group values, row choices, data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortscope.operators.groups import (
    add_timepoint,
    argmax_row_per_group,
    dedupe_keep_first,
    first_per_group,
    flag_duplicates,
    last_per_group,
    mark_duplicates,
    middle_element,
    minmax_scale_255,
    slice_numbers,
)
from cohortscope.operators.prefix import exact_percentiles, running_totals
from cohortscope.operators.profiles import (
    all_hold,
    any_hold,
    average_ranks,
    conditional_median,
    count_or_zero,
    dataset_statistics,
    feature_combinations,
    five_number_summary,
    mean_ci,
    positive_rate,
    value_counts,
    with_average_rank,
)
from cohortscope.operators.quality import (
    check_equal_counts,
    check_implies,
    check_not_null,
    check_size,
    check_unique,
    implies_violations,
    keys_match,
    null_profile,
    selection_funnel,
)
from cohortscope.operators.selection import stack_datasets
from cohortscope.sources.catalog import check_paths_exist
from workload.base import (
    CLINICAL_SQL,
    COHORT_SQL,
    SCANS_SQL,
    clinical,
    cohort,
    query,
    rounded,
    scans,
    table,
)

# --- aggregations -----------------------------------------------------------------------------


@query(
    "feature_combinations",
    """SELECT l_quantity, l_returnflag, l_linestatus, count(*) AS n FROM lineitem
       GROUP BY ALL ORDER BY n DESC""",
)
def feature_combinations_query(spark, sf_dir):
    return feature_combinations(
        table(spark, sf_dir, "lineitem"), ["l_quantity", "l_returnflag", "l_linestatus"]
    )


@query("value_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def value_counts_query(spark, sf_dir):
    return value_counts(table(spark, sf_dir, "events"), "event_type")


@query(
    "count_or_zero",
    """SELECT k AS event_type, (SELECT count(*) FROM events WHERE event_type = k) AS n
       FROM (VALUES ('click'), ('refund')) t(k)""",
)
def count_or_zero_query(spark, sf_dir):
    counts = value_counts(table(spark, sf_dir, "events"), "event_type")
    return count_or_zero(counts, "event_type", ["click", "refund"])


@query("n_unique", "SELECT count(DISTINCT o_custkey) AS n_subjects FROM orders")
def n_unique_query(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(F.countDistinct("o_custkey").alias("n_subjects"))


@query("distinct_values", "SELECT DISTINCT lang, source FROM documents")
def distinct_values_query(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("lang", "source").distinct()


@query(
    "dataset_statistics",
    """SELECT count(*) AS n, CAST(sum(quality) AS BIGINT) AS n_events,
              round(100.0 * sum(quality) / count(*), 9) AS pct_events,
              CAST(count(*) - sum(quality) AS BIGINT) AS n_no_events,
              round(100.0 * (count(*) - sum(quality)) / count(*), 9) AS pct_no_events FROM labels""",
)
def dataset_statistics_query(spark, sf_dir):
    stats = dataset_statistics(table(spark, sf_dir, "labels"), "quality")
    return stats.select(
        "n", "n_events", rounded("pct_events"), "n_no_events", rounded("pct_no_events")
    )


@query("positive_rate", "SELECT round(avg(CAST(quality AS DOUBLE)), 9) AS rate FROM labels")
def positive_rate_query(spark, sf_dir):
    return table(spark, sf_dir, "labels").agg(
        rounded(positive_rate(F.col("quality")), 9, "rate")
    )


@query(
    "conditional_median",
    f"""WITH {COHORT_SQL}
        SELECT event, count(years_to_event) AS n, median(years_to_event) AS median
        FROM cohort WHERE years_to_event IS NOT NULL GROUP BY 1""",
)
def conditional_median_query(spark, sf_dir):
    return conditional_median(cohort(spark, sf_dir), "years_to_event")


@query(
    "count_if",
    """SELECT count(*) FILTER (l_quantity <= 3 AND l_returnflag = 'R') AS n_thin,
              count(*) FILTER (l_discount = 0) AS n_zero, count(*) FILTER (l_tax IS NULL) AS n_null
       FROM lineitem""",
)
def count_if_query(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(
        F.count_if((F.col("l_quantity") <= 3) & (F.col("l_returnflag") == "R")).alias("n_thin"),
        F.count_if(F.col("l_discount") == 0).alias("n_zero"),
        F.count_if(F.col("l_tax").isNull()).alias("n_null"),
    )


@query(
    "mean_ci",
    """SELECT l_returnflag, round(avg(l_extendedprice), 6) AS mean,
              round(quantile_cont(l_extendedprice, 0.025), 6) AS lower_bound,
              round(quantile_cont(l_extendedprice, 0.975), 6) AS upper_bound
       FROM lineitem GROUP BY 1""",
)
def mean_ci_query(spark, sf_dir):
    intervals = mean_ci(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag"])
    return intervals.select(
        "l_returnflag", *[rounded(c, 6) for c in ("mean", "lower_bound", "upper_bound")]
    )


@query(
    "exact_percentiles",
    """SELECT count(value) AS n, round(quantile_cont(value, 0.1), 9) AS p10,
              round(quantile_cont(value, 0.5), 9) AS p50, round(quantile_cont(value, 0.99), 9) AS p99
       FROM events""",
)
def exact_percentiles_query(spark, sf_dir):
    found = exact_percentiles(
        table(spark, sf_dir, "events"), "value", {"p10": 0.1, "p50": 0.5, "p99": 0.99}
    )
    return found.select("n", *[rounded(c) for c in ("p10", "p50", "p99")])


@query(
    "argmax_row_per_group",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (
         SELECT *, row_number() OVER (PARTITION BY l_orderkey
           ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem)
       WHERE rn = 1""",
)
def argmax_row_per_group_query(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"
    )
    return argmax_row_per_group(
        lines, "l_orderkey", "l_quantity", ["l_linenumber", "l_partkey", "l_suppkey"]
    )


@query(
    "five_number_summary",
    """WITH q AS (SELECT event_type, count(*) AS n, quantile_cont(value, 0.25) AS q1,
                         median(value) AS med, quantile_cont(value, 0.75) AS q3
                  FROM events GROUP BY 1)
       SELECT e.event_type, max(n) AS n, round(max(q1), 9) AS q1, round(max(med), 9) AS median,
              round(max(q3), 9) AS q3,
              min(value) FILTER (value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1)) AS whisker_low,
              max(value) FILTER (value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
              count(*) FILTER (NOT (value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1))) AS n_outliers
       FROM events e JOIN q ON e.event_type = q.event_type GROUP BY 1""",
)
def five_number_summary_query(spark, sf_dir):
    summary = five_number_summary(table(spark, sf_dir, "events"), "value", ["event_type"])
    return summary.withColumns({c: F.round(c, 9) for c in ("q1", "median", "q3")})


@query(
    "all_hold",
    """SELECT o_custkey, bool_and(o_totalprice > 20000) AS all_large, bool_or(o_orderstatus = 'P') AS any_open
       FROM orders GROUP BY 1""",
)
def all_hold_query(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        all_hold(F.col("o_totalprice") > 20000).alias("all_large"),
        any_hold(F.col("o_orderstatus") == "P").alias("any_open"),
    )


@query(
    "global_max",
    """SELECT greatest((SELECT max(s_acctbal) FROM supplier), (SELECT max(c_acctbal) FROM customer))
       AS top""",
)
def global_max_query(spark, sf_dir):
    """One maximum over stacked datasets."""
    stacked = stack_datasets(
        {
            "supplier": table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("v")),
            "customer": table(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("v")),
        }
    )
    return stacked.agg(F.max("v").alias("top"))


# --- group values and row choices -------------------------------------------------------------


@query(
    "add_timepoint",
    """SELECT o_orderkey, o_custkey, year(o_orderdate) AS scan_year,
              year(o_orderdate) - min(year(o_orderdate)) OVER (PARTITION BY o_custkey) AS timepoint
       FROM orders""",
)
def add_timepoint_query(spark, sf_dir):
    dated = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.year("o_orderdate").alias("scan_year")
    )
    return add_timepoint(dated, "o_custkey", "scan_year")


@query(
    "first_per_group",
    """SELECT o_custkey, o_orderkey, o_orderdate FROM (
         SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn
         FROM orders) WHERE rn = 1""",
)
def first_per_group_query(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return first_per_group(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query(
    "last_per_group",
    """SELECT o_custkey, o_orderkey, o_orderdate FROM (
         SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
         FROM orders) WHERE rn = 1""",
)
def last_per_group_query(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return last_per_group(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query(
    "dedupe_keep_first",
    f"""WITH {SCANS_SQL}
        SELECT pid, scan_year, thickness, scan, position, part FROM (
          SELECT *, row_number() OVER (PARTITION BY pid, scan_year
            ORDER BY thickness, scan, position, part) AS rn FROM scans) WHERE rn = 1""",
)
def dedupe_keep_first_query(spark, sf_dir):
    """The thinnest scan per subject and year."""
    cases = scans(spark, sf_dir).select("pid", "scan_year", "thickness", "scan", "position", "part")
    return dedupe_keep_first(cases, ["pid", "scan_year"], ["thickness", "scan", "position"])


@query(
    "flag_duplicates",
    """WITH d AS (SELECT l_orderkey, l_linenumber, l_returnflag, count(*) AS n_copies
                  FROM lineitem GROUP BY ALL)
       SELECT *, CAST(n_copies - CASE WHEN row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                ORDER BY l_returnflag) = 1 THEN 1 ELSE 0 END AS BIGINT) AS n_duplicates FROM d""",
)
def flag_duplicates_query(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return flag_duplicates(lines, ["l_orderkey", "l_linenumber"], ["l_returnflag"])


@query(
    "mark_duplicates",
    """SELECT l_orderkey, l_linenumber, l_suppkey,
              count(*) OVER (PARTITION BY l_orderkey, l_suppkey) > 1 AS is_duplicate FROM lineitem""",
)
def mark_duplicates_query(spark, sf_dir):
    """Every row stays; rows of the same key are marked."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return mark_duplicates(lines, ["l_orderkey", "l_suppkey"])


@query("drop_duplicate_rows", "SELECT DISTINCT l_returnflag, l_quantity, l_discount FROM lineitem")
def drop_duplicate_rows_query(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_discount")
    return lines.dropDuplicates()


@query(
    "minmax_scale_255",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
              CASE WHEN hi > lo THEN CAST(floor(255.0::DOUBLE * (l_extendedprice - lo) / (hi - lo)) AS INTEGER)
                   ELSE 0 END AS scaled
       FROM (SELECT *, min(l_extendedprice) OVER (PARTITION BY l_orderkey) AS lo,
                    max(l_extendedprice) OVER (PARTITION BY l_orderkey) AS hi FROM lineitem)""",
)
def minmax_scale_query(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"
    )
    return minmax_scale_255(lines, ["l_orderkey"], "l_extendedprice").drop("l_extendedprice")


def sliced(spark, sf_dir):
    position = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", position.alias("position")
    )


NUMBERED_SQL = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn,
       count(*) OVER (PARTITION BY l_orderkey) AS n
FROM lineitem"""


@query(
    "middle_element",
    f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM ({NUMBERED_SQL}) WHERE rn - 1 = n // 2",
)
def middle_element_query(spark, sf_dir):
    return middle_element(sliced(spark, sf_dir), "l_orderkey", "position").drop("position")


@query(
    "slice_number",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, rn AS slice_number,
               lpad(CAST(rn AS VARCHAR), 3, '0') || '.png' AS file_name FROM ({NUMBERED_SQL})""",
)
def slice_number_query(spark, sf_dir):
    return slice_numbers(sliced(spark, sf_dir), "l_orderkey", "position").drop("position")


@query(
    "cumulative_counts",
    """SELECT l_linestatus, l_extendedprice, n,
              CAST(sum(n) OVER (PARTITION BY l_linestatus ORDER BY l_extendedprice DESC) AS BIGINT) AS cum_n,
              CAST(sum(n) OVER (PARTITION BY l_linestatus) AS BIGINT) AS total_n
       FROM (SELECT l_linestatus, l_extendedprice, count(*) AS n FROM lineitem GROUP BY ALL)""",
)
def cumulative_counts_query(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    cells = lines.groupBy("l_linestatus", "l_extendedprice").agg(F.count(F.lit(1)).alias("n"))
    return running_totals(cells, "l_extendedprice", ["n"], ["l_linestatus"], descending=True)


@query(
    "average_rank",
    """SELECT value, count(*) AS n, avg(rn) AS avg_rank FROM (
         SELECT value, row_number() OVER (ORDER BY value) AS rn FROM events) GROUP BY 1""",
)
def average_rank_query(spark, sf_dir):
    return average_ranks(table(spark, sf_dir, "events"), "value")


@query(
    "with_average_rank",
    """SELECT event_id, event_type, value,
              avg(rn) OVER (PARTITION BY event_type, value) AS avg_rank FROM (
         SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn FROM events)""",
)
def with_average_rank_query(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return with_average_rank(events, "value", ["event_type"])


# --- data quality -----------------------------------------------------------------------------


@query(
    "check_not_null",
    f"""WITH {CLINICAL_SQL}
        SELECT 'candx_days' AS column_name, count(*) AS n_rows, count(*) - count(candx_days) AS n_null,
               round(100.0 * (count(*) - count(candx_days)) / count(*), 9) AS pct_null FROM clinical
        UNION ALL SELECT 'fup_days', count(*), count(*) - count(fup_days),
               round(100.0 * (count(*) - count(fup_days)) / count(*), 9) FROM clinical""",
)
def check_not_null_query(spark, sf_dir):
    report = check_not_null(clinical(spark, sf_dir), ["candx_days", "fup_days"])
    return report.withColumn("pct_null", F.round("pct_null", 9))


@query(
    "check_unique",
    "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def check_unique_query(spark, sf_dir):
    return check_unique(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


CONFLICT_SQL = CLINICAL_SQL + """,
stated AS (SELECT pid, candx_days, CASE WHEN pid % 10 = 0 THEN 1 - conflc ELSE conflc END AS conflc FROM clinical)"""


def stated(spark, sf_dir):
    """Clinical rows in which every tenth subject's confirmation flag is wrong."""
    wrong = F.when(F.col("pid") % 10 == 0, 1 - F.col("conflc")).otherwise(F.col("conflc"))
    return clinical(spark, sf_dir).select("pid", "candx_days", wrong.alias("conflc"))


@query(
    "check_implies",
    f"""WITH {CONFLICT_SQL}
        SELECT count(*) FILTER (conflc = 1) AS n_a, count(candx_days) AS n_b,
               count(*) FILTER (conflc = 1 AND candx_days IS NULL) AS a_without_b,
               count(*) FILTER (conflc <> 1 AND candx_days IS NOT NULL) AS b_without_a FROM stated""",
)
def check_implies_query(spark, sf_dir):
    return check_implies(
        stated(spark, sf_dir), F.col("conflc") == 1, F.col("candx_days").isNotNull()
    )


@query(
    "implies_violations",
    f"""WITH {CONFLICT_SQL}
        SELECT * FROM stated WHERE (conflc = 1) <> (candx_days IS NOT NULL)""",
)
def implies_violations_query(spark, sf_dir):
    return implies_violations(
        stated(spark, sf_dir), F.col("conflc") == 1, F.col("candx_days").isNotNull()
    )


@query(
    "null_profile",
    "WITH "
    + CLINICAL_SQL
    + " UNION ALL ".join(
        f""" SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_null,
             round(100.0 * (count(*) - count({c})) / count(*), 9) AS pct_null FROM clinical"""
        for c in ("pid", "scr_days0", "scr_days1", "scr_days2", "candx_days", "fup_days", "conflc")
    ),
)
def null_profile_query(spark, sf_dir):
    return null_profile(clinical(spark, sf_dir)).withColumn("pct_null", F.round("pct_null", 9))


@query(
    "keys_match",
    """SELECT coalesce(a.k, b.k) AS pid, CASE WHEN b.k IS NULL THEN 'a' ELSE 'b' END AS only_in
       FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 450000) a
       FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') b ON a.k = b.k
       WHERE a.k IS NULL OR b.k IS NULL""",
)
def keys_match_query(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "pid")
    return keys_match(
        orders.filter("o_totalprice > 450000"), orders.filter("o_orderstatus = 'F'"), "pid"
    )


@query(
    "check_size", "SELECT count(*) AS n_rows, count(*) = 25 AS as_expected FROM nation"
)
def check_size_query(spark, sf_dir):
    return check_size(table(spark, sf_dir, "nation"), 25)


@query(
    "check_equal_counts",
    """SELECT count(*) FILTER (quality = 0) AS n_a, count(*) FILTER (toxic = 1) AS n_b,
              count(*) FILTER (quality = 0) = count(*) FILTER (toxic = 1) AS equal FROM labels""",
)
def check_equal_counts_query(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return check_equal_counts(labels, F.col("quality") == 0, F.col("toxic") == 1)


@query(
    "selection_funnel",
    f"""WITH {SCANS_SQL},
        f AS (SELECT pid, CASE WHEN thickness > 30 THEN 1 WHEN kernel = 'N' THEN 2
                               WHEN plane <> 'F' THEN 3 ELSE 4 END AS gone FROM scans)
        SELECT s AS step, name AS step_name, (SELECT count(*) FROM f WHERE gone > s) AS n_rows,
               (SELECT count(DISTINCT pid) FROM f WHERE gone > s) AS n_subjects
        FROM (VALUES (0, 'input'), (1, 'thickness'), (2, 'kernel'), (3, 'plane')) t(s, name)""",
)
def selection_funnel_query(spark, sf_dir):
    steps = [
        ("thickness", F.col("thickness") <= 30),
        ("kernel", F.col("kernel") != "N"),
        ("plane", F.col("plane") == "F"),
    ]
    return selection_funnel(scans(spark, sf_dir), "pid", steps)


@query(
    "check_paths_exist",
    f"""WITH {SCANS_SQL}
        SELECT o_orderkey, directory FROM (
          SELECT o_orderkey, '/archive/' || o_custkey || '/' || strftime(o_orderdate, '%m-%d-%Y')
                 || '-A-' || o_orderkey AS directory FROM orders)
        WHERE directory NOT IN (SELECT regexp_replace(path, '/[^/]*/[^/]*$', '') FROM scans)""",
)
def check_paths_exist_query(spark, sf_dir):
    """Orders whose study folder holds no file."""
    directory = F.concat(
        F.lit("/archive/"),
        "o_custkey",
        F.lit("/"),
        F.date_format("o_orderdate", "MM-dd-yyyy"),
        F.lit("-A-"),
        "o_orderkey",
    )
    cases = table(spark, sf_dir, "orders").select("o_orderkey", directory.alias("directory"))
    files = scans(spark, sf_dir).select(F.regexp_replace("path", "/[^/]*$", "").alias("path"))
    return check_paths_exist(cases, "directory", files)
