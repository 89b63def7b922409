"""Scalar functions: vectors, paths, dates, survival labels, outcomes."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from cohortscope.functions.dates import parse_date_any
from cohortscope.functions.outcomes import (
    classify_at,
    flip_index,
    normalize_label,
    outcome_label,
)
from cohortscope.functions.paths import (
    join_path,
    parent_dir,
    path_suffixes,
    rewrite_prefix,
    year_from_path,
    zero_pad_path,
)
from cohortscope.functions.survival import (
    days_between,
    days_or_approx,
    event_within,
    floor_years,
    lookup_by_timepoint,
    year_labels,
    years_to_event,
)
from cohortscope.functions.vectors import ct_orientation, parse_vector
from cohortscope.operators.joins import join_clinical
from cohortscope.operators.skew import join_aggregated
from cohortscope.plans.cohort import (
    baseline_cases,
    labelled_cohort,
    labelled_cohort_of_tables,
    thin_axial_cases,
)
from cohortscope.session import scratch_dir
from cohortscope.sources.bucketed import write_bucketed
from workload.base import (
    CLINICAL_SQL,
    COHORT_SQL,
    FLAGGED_SQL,
    SCANS_SQL,
    clinical,
    cohort,
    flagged,
    query,
    scans,
    table,
)

# Direction vectors whose entries depend on discount and tax, so that rounding matters.
VECTOR_SQL = """
CASE l_linenumber
  WHEN 1 THEN '[' || (1 - l_tax) || ', 0, ' || l_discount || ', 0, 1, 0]'
  WHEN 2 THEN '[' || l_tax || ', 1.2, 0, 0, ' || l_discount || ', -1]'
  WHEN 3 THEN '(1, 0, 0, ' || l_tax || ', 0, -1)'
  WHEN 4 THEN '[0.5, 0, 0, 0, 1.5, 0]'
  WHEN 5 THEN 'missing'
  WHEN 6 THEN '[1.5, 0, 0, 0, 0.6, 0]' ELSE NULL END"""


def vector_text():
    def words(*parts):
        return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])

    tax, discount = F.col("l_tax"), F.col("l_discount")
    line = F.col("l_linenumber")
    return (
        F.when(line == 1, words("[", 1 - tax, ", 0, ", discount, ", 0, 1, 0]"))
        .when(line == 2, words("[", tax, ", 1.2, 0, 0, ", discount, ", -1]"))
        .when(line == 3, words("(1, 0, 0, ", tax, ", 0, -1)"))
        .when(line == 4, F.lit("[0.5, 0, 0, 0, 1.5, 0]"))
        .when(line == 5, F.lit("missing"))
        .when(line == 6, F.lit("[1.5, 0, 0, 0, 0.6, 0]"))
    )


ORIENTATION_SQL = f"""
WITH v AS (SELECT l_orderkey, l_linenumber, {VECTOR_SQL} AS text FROM lineitem),
r AS (SELECT *, CASE WHEN text <> 'missing' THEN list_transform(
        string_split(translate(text, '()[]', ''), ','), lambda x: round_even(CAST(x AS DOUBLE), 0)) END AS d
      FROM v)
SELECT l_orderkey, l_linenumber,
       CASE WHEN text IS NULL OR text = 'missing' THEN 'missing'
            WHEN d[1] = 1 AND d[5] = 1 THEN 'axial' WHEN d[2] = 1 AND d[6] = -1 THEN 'sagittal'
            WHEN d[1] = 1 AND d[6] = -1 THEN 'coronal' ELSE 'unknown' END AS orientation
FROM r"""


@query("ct_orientation", ORIENTATION_SQL)
def ct_orientation_query(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(
        "l_orderkey", "l_linenumber", ct_orientation(vector_text()).alias("orientation")
    )


@query(
    "parse_vector",
    f"""WITH v AS (SELECT l_orderkey, l_linenumber, {VECTOR_SQL} AS text FROM lineitem),
        p AS (SELECT *, CASE WHEN text <> 'missing' THEN list_transform(
                string_split(translate(text, '()[]', ''), ','), lambda x: CAST(x AS DOUBLE)) END AS d FROM v)
        SELECT l_orderkey, l_linenumber, d[1] AS x, d[4] AS y, CAST(len(d) AS INTEGER) AS width FROM p""",
)
def parse_vector_query(spark, sf_dir):
    parsed = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", parse_vector(vector_text()).alias("d")
    )
    return parsed.select(
        "l_orderkey",
        "l_linenumber",
        F.get("d", F.lit(0)).alias("x"),
        F.get("d", F.lit(3)).alias("y"),
        F.when(F.col("d").isNotNull(), F.size("d")).alias("width"),
    )


@query(
    "year_from_path",
    f"""WITH {SCANS_SQL},
        p AS (SELECT scan, position, part, CASE WHEN part % 5 = 0 THEN replace(path, '-', '_') ELSE path END
              AS path FROM scans)
        SELECT scan, position, part, TRY_CAST(regexp_extract(path, '[0-9]{{2}}-[0-9]{{2}}-([0-9]{{4}})', 1)
               AS INTEGER) AS scan_year FROM p""",
)
def year_from_path_query(spark, sf_dir):
    """Every fifth path holds no date."""
    path = F.when(F.col("part") % 5 == 0, F.replace("path", F.lit("-"), F.lit("_"))).otherwise(
        F.col("path")
    )
    return scans(spark, sf_dir).select(
        "scan", "position", "part", year_from_path(path).alias("scan_year")
    )


@query(
    "parent_dir",
    f"""WITH {SCANS_SQL}
        SELECT path, array_to_string(list_slice(string_split(path, '/'), 1, -2), '/') AS folder FROM scans""",
)
def parent_dir_query(spark, sf_dir):
    return scans(spark, sf_dir).select("path", parent_dir(F.col("path")).alias("folder"))


@query(
    "path_suffixes",
    f"""WITH {SCANS_SQL},
        f AS (SELECT path, string_split(path, '/') AS parts FROM scans)
        SELECT path, string_split(parts[4], '-')[-1] AS time_suffix,
               string_split(parts[5], '-')[-1] AS series_suffix FROM f""",
)
def path_suffixes_query(spark, sf_dir):
    time_suffix, series_suffix = path_suffixes(F.concat(parent_dir(F.col("path")), F.lit("/")))
    return scans(spark, sf_dir).select(
        "path", time_suffix.alias("time_suffix"), series_suffix.alias("series_suffix")
    )


@query(
    "rewrite_prefix",
    f"WITH {SCANS_SQL} SELECT replace(path, '/archive/', '/data/v2/') AS path FROM scans",
)
def rewrite_prefix_query(spark, sf_dir):
    moved = rewrite_prefix(F.col("path"), "/archive/", "/data/v2/")
    return scans(spark, sf_dir).select(moved.alias("path"))


@query(
    "join_path",
    """SELECT page_id, '/workspace/' || split_part(url, '://', 2) AS path FROM pages""",
)
def join_path_query(spark, sf_dir):
    """Relative paths come as ``./a`` or ``/a``."""
    tail = F.regexp_replace("url", "^https?://", "")
    lead = F.when(F.col("page_id") % 2 == 0, F.lit("./")).otherwise(F.lit("/"))
    return table(spark, sf_dir, "pages").select(
        "page_id", join_path("/workspace", F.concat(lead, tail)).alias("path")
    )


@query(
    "zero_pad_path",
    """SELECT o_orderkey, '/base/case-' || CASE WHEN o_orderkey < 10000
              THEN lpad(CAST(o_orderkey AS VARCHAR), 4, '0') ELSE CAST(o_orderkey AS VARCHAR) END || '.mhd' AS path
       FROM orders""",
)
def zero_pad_path_query(spark, sf_dir):
    path = zero_pad_path("/base", "case-", F.col("o_orderkey"), ".mhd")
    return table(spark, sf_dir, "orders").select("o_orderkey", path.alias("path"))


@query(
    "parse_date_any",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day
       FROM orders""",
)
def parse_date_any_query(spark, sf_dir):
    """Dates written in three formats, and one text that is none."""
    kind = F.col("o_orderkey") % 4
    text = (
        F.when(kind == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when((kind == 1) & (F.year("o_orderdate") >= 2000), F.date_format("o_orderdate", "M/d/yy"))
        .when(kind == 3, F.lit("unknown"))
        .otherwise(F.date_format("o_orderdate", "MM-dd-yyyy"))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", parse_date_any(text).alias("day"))


@query(
    "flip_index",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
              CAST(count(*) OVER (PARTITION BY l_orderkey) - l_linenumber AS INTEGER) AS flipped FROM lineitem""",
)
def flip_index_query(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    sizes = lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_files"))
    flipped = flip_index(F.col("n_files"), F.col("l_linenumber"))
    return join_aggregated(lines, sizes, ["l_orderkey"]).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", flipped.alias("flipped")
    )


@query(
    "normalize_label",
    """SELECT trim(lower(o_orderpriority)) AS priority, count(*) AS n FROM orders GROUP BY 1""",
)
def normalize_label_query(spark, sf_dir):
    """Stray blanks and case do not split a label."""
    ragged = F.when(F.col("o_orderkey") % 2 == 0, F.concat("o_orderpriority", F.lit("  "))).otherwise(
        F.lower("o_orderpriority")
    )
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(normalize_label(ragged).alias("priority")).agg(F.count(F.lit(1)).alias("n"))


# --- survival labels --------------------------------------------------------------------------

TIMED_SQL = f"""
WITH {CLINICAL_SQL},
t AS (
  SELECT o_orderkey, o_custkey AS pid, year(o_orderdate) - 1996 AS timepoint, candx_days, fup_days,
         coalesce(CASE year(o_orderdate) WHEN 1996 THEN scr_days0 WHEN 1997 THEN scr_days1
                    WHEN 1998 THEN scr_days2 END, (year(o_orderdate) - 1996) * 365) AS scan_days
  FROM orders LEFT JOIN clinical ON o_custkey = pid),
y AS (
  SELECT *, candx_days - scan_days AS days_dx, fup_days - scan_days AS days_fup,
         CAST(floor((candx_days - scan_days) / 365.0) AS BIGINT) AS years_dx,
         CAST(floor((fup_days - scan_days) / 365.0) AS BIGINT) AS years_fup FROM t),
e AS (SELECT *, CASE WHEN years_dx < 6 THEN 1 ELSE 0 END AS event FROM y)"""


def timed(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    joined = join_clinical(orders.withColumn("pid", F.col("o_custkey")), clinical(spark, sf_dir))
    timepoint = F.year("o_orderdate") - 1996
    recorded = lookup_by_timepoint([F.col(f"scr_days{i}") for i in range(3)], timepoint)
    return joined.select(
        "o_orderkey",
        "pid",
        timepoint.alias("timepoint"),
        "candx_days",
        "fup_days",
        days_or_approx(recorded, timepoint).alias("scan_days"),
    )


@query("days_or_approx", TIMED_SQL + " SELECT o_orderkey, timepoint, scan_days FROM e")
def days_or_approx_query(spark, sf_dir):
    return timed(spark, sf_dir).select("o_orderkey", "timepoint", "scan_days")


@query("days_between_anchors", TIMED_SQL + " SELECT o_orderkey, days_dx, days_fup FROM e")
def days_between_query(spark, sf_dir):
    return timed(spark, sf_dir).select(
        "o_orderkey",
        days_between(F.col("candx_days"), F.col("scan_days")).alias("days_dx"),
        days_between(F.col("fup_days"), F.col("scan_days")).alias("days_fup"),
    )


def with_years(df):
    dx = floor_years(days_between(F.col("candx_days"), F.col("scan_days")))
    followup = floor_years(days_between(F.col("fup_days"), F.col("scan_days")))
    return df.withColumns({"years_dx": dx, "years_fup": followup})


@query("floor_years", TIMED_SQL + " SELECT o_orderkey, years_dx, years_fup FROM e")
def floor_years_query(spark, sf_dir):
    """Diagnoses before the scan give negative years."""
    return with_years(timed(spark, sf_dir)).select("o_orderkey", "years_dx", "years_fup")


@query("event_within", TIMED_SQL + " SELECT o_orderkey, event FROM e")
def event_within_query(spark, sf_dir):
    years = with_years(timed(spark, sf_dir))
    return years.select("o_orderkey", event_within(F.col("years_dx"), 6).alias("event"))


@query(
    "years_to_event",
    TIMED_SQL
    + """ SELECT o_orderkey, event, CASE WHEN event = 1 THEN years_dx ELSE least(years_fup, 5) END
          AS years_to_event FROM e""",
)
def years_to_event_query(spark, sf_dir):
    event = event_within(F.col("years_dx"), 6)
    time = years_to_event(event, F.col("years_dx"), F.col("years_fup"), 6)
    return with_years(timed(spark, sf_dir)).select(
        "o_orderkey", event.alias("event"), time.alias("years_to_event")
    )


@query(
    "year_labels",
    f"WITH {COHORT_SQL} SELECT pid, event, years_to_event, "
    + ", ".join(
        f"CASE WHEN event = 1 AND {i} >= greatest(least(years_to_event, 6), 0) THEN 1 ELSE 0 END AS y_{i}"
        for i in range(6)
    )
    + " FROM cohort",
)
def year_labels_query(spark, sf_dir):
    labelled = cohort(spark, sf_dir).withColumn(
        "y", year_labels(F.col("event"), F.col("years_to_event"), 6)
    )
    return labelled.select(
        "pid",
        "event",
        "years_to_event",
        *[F.get("y", F.lit(i)).alias(f"y_{i}") for i in range(6)],
    )


@query(
    "classify_at",
    f"""WITH {FLAGGED_SQL}
        SELECT arm, predicted, count(*) AS n FROM (
          SELECT arm, CAST(tied_score >= 0.05 AS INTEGER) AS predicted FROM flagged) GROUP BY 1, 2""",
)
def classify_at_query(spark, sf_dir):
    predicted = flagged(spark, sf_dir).select(
        "arm", classify_at(F.col("tied_score"), 0.05).alias("predicted")
    )
    return predicted.groupBy("arm", "predicted").agg(F.count(F.lit(1)).alias("n"))


@query(
    "outcome_label",
    f"""WITH {COHORT_SQL}
        SELECT pid, CASE WHEN pred_risk_year_1 < 0.05 THEN NULL
               WHEN event = 1 AND pred_risk_year_1 >= 0.5 THEN 'TP' WHEN event = 0 AND pred_risk_year_1 >= 0.5 THEN 'FP'
               WHEN event = 1 THEN 'FN' ELSE 'TN' END AS outcome FROM cohort""",
)
def outcome_label_query(spark, sf_dir):
    """A missing score has no outcome."""
    score = F.when(F.col("pred_risk_year_1") >= 0.05, F.col("pred_risk_year_1"))
    return cohort(spark, sf_dir).select(
        "pid", outcome_label(F.col("event"), score, 0.5).alias("outcome")
    )


# --- whole selection plans --------------------------------------------------------------------


def headers(spark, sf_dir):
    """Order lines as scan headers that the acquisition rules understand."""
    thickness = F.element_at(
        F.array(*[F.lit(x) for x in ("2.5", "2.0", "1.25", "3.2", "1.0", "missing")]),
        (F.col("thickness").cast("int") % 6) + 1,
    )
    kernel = F.element_at(
        F.array(*[F.lit(x) for x in ("STANDARD", "B30f", "FC51", "C", "D")]),
        (F.col("part") % 5).cast("int") + 1,
    )
    plane = F.when(F.col("plane") == "F", "[1, 0, 0, 0, 1, 0]").otherwise("[0, 1, 0, 0, 0, -1]")
    return scans(spark, sf_dir).select(
        F.col("scan").cast("string").alias("AccessionNumber"),
        thickness.alias("SliceThickness"),
        kernel.alias("ConvolutionKernel"),
        plane.alias("ImageOrientationPatient"),
        F.col("pid").cast("string").alias("Patient_ID"),
        F.col("path").alias("Directory"),
    )


HEADERS_SQL = f"""
{SCANS_SQL},
headers AS (
  SELECT CAST(scan AS VARCHAR) AS accession, pid, path, scan_year,
         ['2.5', '2.0', '1.25', '3.2', '1.0', 'missing'][CAST(thickness AS INTEGER) % 6 + 1] AS thickness,
         ['STANDARD', 'B30f', 'FC51', 'C', 'D'][CAST(part % 5 AS INTEGER) + 1] AS kernel,
         CASE WHEN plane = 'F' THEN 'axial' ELSE 'sagittal' END AS plane,
         scan_year - min(scan_year) OVER (PARTITION BY pid) AS timepoint
  FROM scans)"""

LABELLED_SQL = f"""
WITH {HEADERS_SQL}, {CLINICAL_SQL},
ruled AS (
  SELECT *, CASE WHEN plane = 'axial' THEN CASE thickness || kernel
    WHEN '2.5STANDARD' THEN 1 WHEN '2.0B30f' THEN 2 WHEN '2.0FC51' THEN 3 WHEN '1.25STANDARD' THEN 4
    WHEN '3.2C' THEN 5 WHEN '2.0C' THEN 6 WHEN '3.2D' THEN 7 WHEN '1.0B30f' THEN 8 END END AS tier FROM headers),
best AS (
  SELECT *, min(CASE WHEN tier <= 2 THEN 1 ELSE tier END) OVER (PARTITION BY pid) AS b
  FROM ruled WHERE tier IS NOT NULL),
one AS (
  SELECT *, row_number() OVER (PARTITION BY pid ORDER BY tier {{order}}, path {{order}}) AS rn
  FROM best WHERE CASE WHEN tier <= 2 THEN 1 ELSE tier END = b),
days AS (
  SELECT one.*, candx_days, fup_days,
         coalesce(CASE timepoint WHEN 0 THEN scr_days0 WHEN 1 THEN scr_days1 WHEN 2 THEN scr_days2 END,
                  timepoint * 365) AS scan_days
  FROM one LEFT JOIN clinical c ON one.pid = c.pid WHERE rn = 1),
years AS (
  SELECT *, CAST(floor((candx_days - scan_days) / 365.0) AS BIGINT) AS dx,
         CAST(floor((fup_days - scan_days) / 365.0) AS BIGINT) AS fup FROM days)
SELECT pid, CASE WHEN dx < 6 THEN 1 ELSE 0 END AS event,
       CASE WHEN dx < 6 THEN dx ELSE least(fup, 5) END AS years_to_event,
       dx AS years_from_scan_to_diagnosis, fup AS years_from_scan_to_last_followup,
       scan_year AS "Year", timepoint, accession AS "AccessionNumber",
       regexp_replace(path, '/[^/]*$', '') AS "Directory"
FROM years"""


@query("labelled_cohort_baseline", LABELLED_SQL.format(order=""))
def labelled_baseline_query(spark, sf_dir):
    """Selection and labelling end to end, first scan per subject."""
    return labelled_cohort(
        headers(spark, sf_dir), clinical(spark, sf_dir), "baseline", max_followup=6
    )


@query("labelled_cohort_bucketed", LABELLED_SQL.format(order=""))
def labelled_bucketed_query(spark, sf_dir):
    """The same from two tables stored by subject, with no shuffle after they are written."""
    names = [f"{kind}_{uuid4().hex}" for kind in ("headers", "clinical")]
    whole = headers(spark, sf_dir).withColumn("Patient_ID", F.col("Patient_ID").cast("long"))
    write_bucketed(whole, names[0], "Patient_ID", 16, scratch_dir(spark, "headers"))
    write_bucketed(clinical(spark, sf_dir), names[1], "pid", 16, scratch_dir(spark, "clinical"))
    return labelled_cohort_of_tables(spark, *names, timepoint="baseline", max_followup=6)


@query("labelled_cohort_latest", LABELLED_SQL.format(order="DESC"))
def labelled_latest_query(spark, sf_dir):
    """The same with the last scan per subject."""
    return labelled_cohort(headers(spark, sf_dir), clinical(spark, sf_dir), "latest", max_followup=6)


@query(
    "thin_axial_baseline",
    f"""WITH {HEADERS_SQL},
        thin AS (
          SELECT CAST(pid AS VARCHAR) AS pid, scan_year AS timepoint, accession, thickness, kernel, path,
                 row_number() OVER (PARTITION BY pid, scan_year ORDER BY CAST(thickness AS DOUBLE),
                   accession, thickness, kernel, path) AS rn
          FROM headers WHERE thickness <> 'missing' AND TRY_CAST(thickness AS DOUBLE) <= 3 AND plane = 'axial'),
        one AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY timepoint) AS first FROM thin WHERE rn = 1)
        SELECT pid, timepoint, accession AS "AccessionNumber", thickness AS "SliceThickness",
               kernel AS "ConvolutionKernel", path AS "Directory" FROM one WHERE first = 1""",
)
def thin_axial_query(spark, sf_dir):
    """The other selection: exclusions, thinnest scan per timepoint, then the first timepoint."""
    described = headers(spark, sf_dir).select(
        F.col("Patient_ID").alias("pid"),
        F.regexp_extract("Directory", r"\d\d-\d\d-(\d{4})", 1).cast("int").alias("timepoint"),
        "AccessionNumber",
        "SliceThickness",
        "ConvolutionKernel",
        "Directory",
        ct_orientation(F.col("ImageOrientationPatient")).alias("Orientation"),
    )
    return baseline_cases(thin_axial_cases(described)).drop("Orientation")
