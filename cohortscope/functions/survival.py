"""Event, time-to-event and per-year labels as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS_PER_YEAR = 365


def lookup_by_timepoint(columns: Sequence[Column], timepoint: Column) -> Column:
    """The column that belongs to the row's timepoint; NULL outside the range."""
    return F.get(F.array(*columns), timepoint)


def days_or_approx(days: Column, timepoint: Column, days_per_year: int = DAYS_PER_YEAR) -> Column:
    """Recorded day of the scan, or ``timepoint`` years where it was not recorded."""
    return F.coalesce(days, timepoint * F.lit(days_per_year))


def days_between(end: Column, start: Column) -> Column:
    """Days from one anchor to another, NULL if either is missing."""
    return end - start


def floor_years(days: Column, days_per_year: int = DAYS_PER_YEAR) -> Column:
    """Whole years, rounded down below zero too (-10 days is year -1)."""
    return F.floor(days / F.lit(days_per_year))


def event_within(years_to_diagnosis: Column, max_followup: int) -> Column:
    """1 if the diagnosis lies before ``max_followup`` years, else 0 (also when there is none)."""
    return F.when(years_to_diagnosis < max_followup, 1).otherwise(0)


def years_to_event(
    event: Column, years_to_diagnosis: Column, years_to_followup: Column, max_followup: int
) -> Column:
    """Diagnosis year for events, else the follow-up cut at the last year; NULL without follow-up."""
    censored = F.when(
        years_to_followup.isNotNull(), F.least(years_to_followup, F.lit(max_followup - 1))
    )
    return F.when(event == 1, years_to_diagnosis).otherwise(censored)


def year_labels(event: Column, time: Column, years: int) -> Column:
    """0/1 per year: 1 from the event year onward. A diagnosis before the scan counts as year 0."""
    first = F.greatest(F.least(time.cast("int"), F.lit(years)), F.lit(0))
    return F.transform(
        F.sequence(F.lit(0), F.lit(years - 1)),
        lambda year: F.coalesce(((event == 1) & (year >= first)).cast("int"), F.lit(0)),
    )
