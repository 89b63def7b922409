"""Smaller label and path workflows: annotations, nodules, outcomes, corrected folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortscope.functions.outcomes import flag_if, flip_index
from cohortscope.functions.paths import path_suffixes, zero_pad_path
from cohortscope.functions.vectors import parse_vector
from cohortscope.operators.groups import argmax_row_per_group
from cohortscope.operators.joins import join_ci, join_outcome, missing_keys, resolve_by_suffix, semi_by_key
from cohortscope.operators.skew import join_aggregated
from cohortscope.sources.catalog import files_per_folder
from cohortscope.sources.tables import quoted


def annotation_labels(
    annotations: DataFrame,
    root: str,
    prefix: str,
    tie_order: Sequence[str],
    key: str = "pid",
    kind: str = "NodType",
    grade: str = "Malignancy",
    nodule: str = "nod",
    above: float = 3,
) -> DataFrame:
    """One row per scan, its most malignant annotation, with the event flag and image paths.

    A missing or unreadable grade counts as 0. ``tie_order`` is the order of the annotation file and
    decides between equal grades.
    """
    graded = annotations.withColumn(
        grade, F.coalesce(F.col(grade).cast("string").try_cast("double"), F.lit(0.0))
    ).withColumn("event", flag_if((F.col(kind) == nodule) & (F.col(grade) > above)))
    worst = argmax_row_per_group(graded, key, grade, tie_order)
    return worst.select(
        key,
        grade,
        kind,
        "event",
        zero_pad_path(root, prefix, F.col(key), ".mhd").alias("mhd_path"),
        zero_pad_path(root, prefix, F.col(key), ".raw").alias("raw_path"),
    )


def nodule_slices(
    cases: DataFrame,
    nodules: DataFrame,
    files: DataFrame,
    directory: str = "Directory",
    position: str = "Nodule Center x,y Position*",
    image: str = "Nodule Center Image",
) -> DataFrame:
    """One row per case and nodule: image number from the other end of the stack, x and y.

    Subject ids are compared without regard to case. ``files`` is a file catalogue; a case whose
    folder is not in it has no slice.
    """
    located = join_ci(cases, nodules, "pid", "pid")
    sizes = files_per_folder(files).withColumnRenamed("folder", directory)
    counted = join_aggregated(located, sizes, [directory], "left")
    xy = parse_vector(F.col(quoted(position)))
    return counted.withColumns(
        {
            "nodule_slice": flip_index(F.col("n_files"), F.col(quoted(image))),
            "x": F.get(xy, F.lit(0)),
            "y": F.get(xy, F.lit(1)),
        }
    )


def cases_with_outcome(
    cases: DataFrame,
    diagnoses: DataFrame,
    wanted: DataFrame,
    columns: Sequence[str] = ("lung_cancer", "event_1"),
    key: str = "pid",
    diagnosis_key: str = "patient_id",
) -> tuple[DataFrame, DataFrame]:
    """Wanted cases with their outcome columns, and the wanted ids that have no diagnosis.

    Repeated diagnosis rows are dropped first. ``wanted`` has the column ``key``.
    """
    known = semi_by_key(diagnoses.dropDuplicates(), wanted, diagnosis_key, key)
    chosen = semi_by_key(cases, wanted, key)
    return (
        join_outcome(chosen, known, key, diagnosis_key, columns),
        missing_keys(wanted, diagnoses, key, diagnosis_key),
    )


def corrected_paths(
    incorrect: DataFrame, correct: DataFrame, catalog: DataFrame, directory: str = "Directory"
) -> DataFrame:
    """Replace outdated folders by those found in the catalogue and add the correct cases.

    ``catalog`` has ``pid``, ``study``, ``series`` and ``path`` per folder. A folder is recognised by
    the last tokens of its study and series names.
    """
    study, series = path_suffixes(F.col(directory))
    marked = incorrect.withColumns({"_study_token": study, "_series_token": series})
    found = resolve_by_suffix(
        marked, catalog, "pid", ("_study_token", "study"), ("_series_token", "series")
    )
    fixed = found.drop(directory, "_study_token", "_series_token", "n_matches", "match_status")
    return correct.unionByName(fixed.withColumnRenamed("resolved_path", directory))
