"""Query registry and the derived tables several queries start from.

Each derived table exists twice, as a DataFrame and as SQL text, written independently.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortscope.functions.survival import (
    days_between,
    event_within,
    floor_years,
    years_to_event,
)
from cohortscope.schemas import score_columns

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

YEARS = 6
SCORES = score_columns(YEARS)
CUTOFF = 0.0121


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can say it, the statement it must agree with."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(column: str | Column, digits: int = 9, name: str | None = None) -> Column:
    """Round for comparison with another engine's summation order."""
    value = F.col(column) if isinstance(column, str) else column
    return F.round(value, digits).alias(name or column)


# --- scans: an order line is a scan, its order's customer the subject ---------------------------

SCANS_SQL = """
scans AS (
  SELECT o_custkey AS pid, o_orderkey AS scan, l_linenumber AS position,
         year(o_orderdate) AS scan_year, CAST(o_orderdate AS DATE) AS scan_date,
         l_quantity AS thickness, l_returnflag AS kernel, l_linestatus AS plane,
         l_partkey AS part, l_extendedprice AS price,
         '/archive/' || o_custkey || '/' || strftime(o_orderdate, '%m-%d-%Y') || '-A-' || o_orderkey
           || '/' || l_linenumber || '.000-S' || l_partkey || '-' || l_suppkey || '/'
           || CAST(CAST(l_extendedprice * 100 AS BIGINT) AS VARCHAR) || '.dcm' AS path
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long").cast("string")
    path = F.concat(
        F.lit("/archive/"),
        F.col("o_custkey"),
        F.lit("/"),
        F.date_format("o_orderdate", "MM-dd-yyyy"),
        F.lit("-A-"),
        F.col("o_orderkey"),
        F.lit("/"),
        F.col("l_linenumber"),
        F.lit(".000-S"),
        F.col("l_partkey"),
        F.lit("-"),
        F.col("l_suppkey"),
        F.lit("/"),
        cents,
        F.lit(".dcm"),
    )
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("pid"),
        F.col("o_orderkey").alias("scan"),
        F.col("l_linenumber").alias("position"),
        F.year("o_orderdate").alias("scan_year"),
        F.col("o_orderdate").cast("date").alias("scan_date"),
        F.col("l_quantity").alias("thickness"),
        F.col("l_returnflag").alias("kernel"),
        F.col("l_linestatus").alias("plane"),
        F.col("l_partkey").alias("part"),
        F.col("l_extendedprice").alias("price"),
        path.alias("path"),
    )


def folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pid``, ``study``, ``series`` and ``path`` of each folder that holds a scan.

    A folder names its order, so copies are found where the scans were joined by it, without another shuffle. A scan
    that lacks a path is in no folder.
    """
    held = scans(spark, sf_dir).filter(F.col("path").isNotNull())
    found = held.select("pid", "scan", F.substring_index("path", "/", 5).alias("path")).distinct()
    study, series = (F.substring_index(F.substring_index("path", "/", i), "/", -1) for i in (4, 5))
    return found.select("pid", study.alias("study"), series.alias("series"), "path")


# --- clinical: days of the first order of 1996, 1997, 1998, first failed order, last order -------

CLINICAL_SQL = """
clinical AS (
  SELECT o_custkey AS pid,
         CAST(min(CASE WHEN year(o_orderdate) = 1996 THEN d END) AS BIGINT) AS scr_days0,
         CAST(min(CASE WHEN year(o_orderdate) = 1997 THEN d END) AS BIGINT) AS scr_days1,
         CAST(min(CASE WHEN year(o_orderdate) = 1998 THEN d END) AS BIGINT) AS scr_days2,
         CAST(min(CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN d END) AS BIGINT)
           AS candx_days,
         CAST(max(d) AS BIGINT) AS fup_days,
         max(CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS conflc
  FROM (SELECT *, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS d FROM orders)
  GROUP BY o_custkey
)"""


def clinical(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    day = F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("long")
    diagnosed = (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")
    in_year = [F.when(F.year("o_orderdate") == 1996 + i, day) for i in range(3)]
    return orders.groupBy(F.col("o_custkey").alias("pid")).agg(
        *[F.min(c).alias(f"scr_days{i}") for i, c in enumerate(in_year)],
        F.min(F.when(diagnosed, day)).alias("candx_days"),
        F.max(day).alias("fup_days"),
        F.max(F.when(diagnosed, 1).otherwise(0)).alias("conflc"),
    )


# --- cohort: event and time to event per customer, six per-year scores from the account balance --

COHORT_SQL = CLINICAL_SQL + """,
anchored AS (
  SELECT c.*, first_day,
         CAST(floor((candx_days - first_day) / 365.0) AS BIGINT) AS years_dx,
         CAST(floor((fup_days - first_day) / 365.0) AS BIGINT) AS years_fup
  FROM clinical c JOIN (
    SELECT o_custkey, min(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE))) AS first_day
    FROM orders GROUP BY o_custkey) f ON c.pid = f.o_custkey
),
cohort AS (
  SELECT pid, CASE WHEN years_dx < 6 THEN 1 ELSE 0 END AS event,
         CASE WHEN years_dx < 6 THEN years_dx ELSE least(years_fup, 5) END AS years_to_event,
         """ + ",\n         ".join(
    f"((abs(CAST(round(c_acctbal * 100) AS BIGINT)) * {2 * i + 3} + pid) % 997) / 997.0 AS {s}"
    for i, s in enumerate(SCORES)
) + """
  FROM anchored JOIN customer ON pid = c_custkey
)"""


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    day = F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("long")
    diagnosed = (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")
    anchors = orders.groupBy(F.col("o_custkey").alias("pid")).agg(
        F.min(day).alias("first_day"),
        F.min(F.when(diagnosed, day)).alias("candx_days"),
        F.max(day).alias("fup_days"),
    )
    dx = floor_years(days_between(F.col("candx_days"), F.col("first_day")))
    followup = floor_years(days_between(F.col("fup_days"), F.col("first_day")))
    balance = F.abs(F.round(F.col("c_acctbal") * 100).cast("long"))
    scored = [
        (((balance * (2 * i + 3) + F.col("pid")) % 997) / F.lit(997.0)).alias(s)
        for i, s in enumerate(SCORES)
    ]
    event = event_within(dx, YEARS)
    return anchors.join(customers, anchors.pid == customers.c_custkey).select(
        "pid",
        event.alias("event"),
        years_to_event(event, dx, followup, YEARS).alias("years_to_event"),
        *scored,
    )


# --- graded: documents with a quality label, scored by their length ------------------------------

GRADED_SQL = """
graded AS (
  SELECT d.doc_id, (n_chars % 1000) / 1000.0 AS score, quality AS label
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
)"""


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return documents.join(labels, "doc_id").select(
        "doc_id",
        ((F.col("n_chars") % 1000) / F.lit(1000.0)).alias("score"),
        F.col("quality").alias("label"),
    )


# --- flagged: order lines, label "returned"; scores with few and with many distinct values --------

FLAGGED_SQL = """
flagged AS (
  SELECT l_discount AS tied_score, l_extendedprice AS fine_score, l_linestatus AS arm,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label
  FROM lineitem
)"""


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_discount").alias("tied_score"),
        F.col("l_extendedprice").alias("fine_score"),
        F.col("l_linestatus").alias("arm"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
    )
