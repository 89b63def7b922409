"""Thresholded scores and the sets they fall into."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flag_if(condition: Column) -> Column:
    """1 where the condition holds, 0 where it does not or is unknown."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def classify_at(score: Column, cutoff: float) -> Column:
    """Binary prediction; a missing score stays NULL."""
    return (score >= F.lit(cutoff)).cast("int")


def outcome_label(event: Column, score: Column, cutoff: float) -> Column:
    """TP, FP, FN or TN; NULL for a missing score or a label other than 0 and 1."""
    above = score >= F.lit(cutoff)
    return (
        F.when((event == 1) & above, "TP")
        .when((event == 0) & above, "FP")
        .when((event == 1) & ~above, "FN")
        .when((event == 0) & ~above, "TN")
    )


def flip_index(n_files: Column, position: Column) -> Column:
    """Position counted from the other end of a stack of ``n_files``."""
    return (n_files - position).cast("int")


def normalize_label(text: Column) -> Column:
    """Label text without stray blanks and case."""
    return F.trim(F.lower(text))
