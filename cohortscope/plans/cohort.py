"""From header metadata and a clinical table to one labelled scan per subject."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortscope.functions.paths import parent_dir, year_from_path
from cohortscope.functions.survival import (
    DAYS_PER_YEAR,
    days_between,
    days_or_approx,
    event_within,
    floor_years,
    lookup_by_timepoint,
    years_to_event,
)
from cohortscope.functions.vectors import ct_orientation
from cohortscope.operators.groups import dedupe_keep_first, first_per_group
from cohortscope.operators.joins import join_clinical
from cohortscope.operators.projection import drop_sentinels, max_bound, to_numeric
from cohortscope.operators.selection import acquisition_tiers, with_tiers
from cohortscope.sources.bucketed import co_located
from cohortscope.sources.tables import SENTINELS

LABELLED_COLUMNS = [
    "pid",
    "event",
    "years_to_event",
    "years_from_scan_to_diagnosis",
    "years_from_scan_to_last_followup",
    "Year",
    "timepoint",
    "AccessionNumber",
    "Directory",
]


def describe_scans(headers: DataFrame) -> DataFrame:
    """Header rows with scan plane and year, thickness as a number."""
    thickness = F.col("SliceThickness")
    if not isinstance(headers.schema["SliceThickness"].dataType, T.NumericType):
        thickness = to_numeric(thickness.cast("string"))
    return headers.withColumns(
        {
            "Orientation": ct_orientation(F.col("ImageOrientationPatient")),
            "Year": year_from_path(F.col("Directory")),
            "SliceThickness": thickness.cast("double"),
            "ConvolutionKernel": F.col("ConvolutionKernel").cast("string"),
        }
    )


def select_scans(
    headers: DataFrame,
    timepoint: str = "baseline",
    tiers: Sequence[tuple[int, Column]] | None = None,
    include: Column | None = None,
) -> DataFrame:
    """One scan per subject by acquisition rules, with its ``timepoint``.

    ``baseline`` takes the first and ``latest`` the last scan in (rule, path) order of the best batch
    the subject reaches; the timepoint counts years from the first of *all* scans of the subject.

    Both the choice and the first year are reduced to one row per subject before anything is
    shuffled, so the full table never moves.
    """
    scans = describe_scans(headers)
    ranked = with_tiers(scans, tiers or acquisition_tiers(), include)
    within = {
        "baseline": [F.col("tier").asc(), F.col("Directory").asc()],
        "latest": [F.col("tier").desc(), F.col("Directory").desc()],
    }[timepoint]
    one = first_per_group(ranked, ["Patient_ID"], [F.col("batch"), *within]).drop("batch")
    first_year = scans.groupBy("Patient_ID").agg(F.min("Year").alias("_first_year"))
    return (
        one.join(first_year, "Patient_ID")
        .withColumns(
            {
                "timepoint": F.col("Year") - F.col("_first_year"),
                "Directory": parent_dir(F.col("Directory")),
            }
        )
        .drop("_first_year")
        .withColumnRenamed("Patient_ID", "pid")
    )


def label_survival(
    scans: DataFrame,
    clinical: DataFrame,
    max_followup: int = 1,
    days_per_year: int = DAYS_PER_YEAR,
    n_timepoints: int = 3,
    by_bucket: bool = False,
) -> DataFrame:
    """Join the clinical table and derive event and time to event, in years from the scan.

    ``by_bucket`` says that both lie by subject in buckets of bounded size, see ``sources.bucketed``.
    """
    joined = scans.join(clinical, "pid", "left") if by_bucket else join_clinical(scans, clinical)
    days = [F.col(f"scr_days{i}") for i in range(n_timepoints)]
    return (
        joined.withColumn(
            "days_from_randomization_to_scan",
            days_or_approx(
                lookup_by_timepoint(days, F.col("timepoint")), F.col("timepoint"), days_per_year
            ),
        )
        .withColumns(
            {
                f"days_from_scan_to_{name}": days_between(
                    F.col(end), F.col("days_from_randomization_to_scan")
                )
                for name, end in (("diagnosis", "candx_days"), ("last_followup", "fup_days"))
            }
        )
        .withColumns(
            {
                f"years_from_scan_to_{name}": floor_years(F.col(f"days_from_scan_to_{name}"))
                for name in ("diagnosis", "last_followup")
            }
        )
        .withColumn("event", event_within(F.col("years_from_scan_to_diagnosis"), max_followup))
        .withColumn(
            "years_to_event",
            years_to_event(
                F.col("event"),
                F.col("years_from_scan_to_diagnosis"),
                F.col("years_from_scan_to_last_followup"),
                max_followup,
            ),
        )
    )


def labelled_cohort(
    headers: DataFrame,
    clinical: DataFrame,
    timepoint: str = "baseline",
    max_followup: int = 1,
    include: Column | None = None,
    tiers: Sequence[tuple[int, Column]] | None = None,
    days_per_year: int = DAYS_PER_YEAR,
    n_timepoints: int = 3,
    by_bucket: bool = False,
) -> DataFrame:
    """Selection and labelling in one lazy plan, with the columns later stages use."""
    scans = select_scans(headers, timepoint, tiers, include)
    scans = scans.withColumn("pid", F.col("pid").cast("long"))
    labelled = label_survival(scans, clinical, max_followup, days_per_year, n_timepoints, by_bucket)
    return labelled.select(*LABELLED_COLUMNS)


def labelled_cohort_of_tables(spark: SparkSession, headers: str, clinical: str, **options) -> DataFrame:
    """``labelled_cohort`` of two stored tables, bucket by bucket where they lie so.

    With headers bucketed by ``Patient_ID`` and the clinical table by ``pid``, both whole numbers in as many
    buckets, choosing the scans, finding the first year and joining shuffle nothing. Tables that aren't bucketed
    alike, or hold a subject too large for a task, take the ordinary way and give the same rows.
    """
    by_bucket = co_located(spark, headers, "Patient_ID", clinical, "pid")
    return labelled_cohort(spark.table(headers), spark.table(clinical), by_bucket=by_bucket, **options)


def thin_axial_cases(cases: DataFrame, max_thickness: float = 3.0) -> DataFrame:
    """Axial scans of known kernel up to ``max_thickness``, the thinnest per subject and timepoint."""
    kept = drop_sentinels(cases, ["SliceThickness", "ConvolutionKernel"], SENTINELS)
    kept = max_bound(kept, "SliceThickness", max_thickness).filter(F.col("Orientation") == "axial")
    thinnest = F.col("SliceThickness").cast("double")
    return dedupe_keep_first(kept, ["pid", "timepoint"], [thinnest])


def baseline_cases(cases: DataFrame) -> DataFrame:
    """The earliest timepoint of each subject."""
    return dedupe_keep_first(cases, ["pid"], ["timepoint"])
