"""File catalogues: one row per file, folders derived from the path."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from fnmatch import fnmatch

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortscope.functions.paths import parent_dir
from cohortscope.operators.skew import join_aggregated


# No file system allows longer paths.
MAX_PATH = 65536


def file_catalog(
    spark: SparkSession, root: str, glob: str = "*", levels: Sequence[str] = ()
) -> DataFrame:
    """Recursive listing with ``path`` and ``length``; file contents are never read.

    ``levels`` names the folders below ``root`` (patient, timepoint, scan ..), one column each.
    Spark keeps the listing of a source in the driver: for more than some millions of files use
    ``file_catalog_by_folder``.
    """
    listed = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(root)
        .select("path", "length")
    )
    return with_levels(listed, root, levels) if levels else listed


def file_catalog_by_folder(
    folders: DataFrame, root: str, glob: str = "*", levels: Sequence[str] = ()
) -> DataFrame:
    """The same listing for trees of any size: tasks list the folders named in ``folders``.

    ``folders`` has one column with folder names below ``root`` (the patients of a case table, say).
    Neither the folder names nor the files pass through the driver. Missing folders give no rows.
    """
    name = folders.columns[0]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = fs.FileSystem.from_uri(root)
        base = base.rstrip("/")
        for batch in batches:
            # One directory at a time, so that a tree of any depth needs the memory of its widest one.
            below = [f"{base}/{folder}" for folder in batch[name]]
            while below:
                chosen = fs.FileSelector(below.pop(), allow_not_found=True)
                found = system.get_file_info(chosen)
                below += [i.path for i in found if i.type == fs.FileType.Directory]
                files = [i for i in found if i.is_file and fnmatch(i.base_name, glob)]
                paths = [f"{root.rstrip('/')}{i.path[len(base):]}" for i in files]
                sizes = [i.size for i in files]
                yield pd.DataFrame({"path": paths, "length": sizes}).astype(
                    {"path": object, "length": "int64"}
                )

    spread = folders.select(F.col(name).cast("string").alias(name)).distinct()
    listed = spread.mapInPandas(walk, "path string, length long")
    return with_levels(listed, root, levels) if levels else listed


# Fixed value: scheme and host in front of a path.
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"


def with_levels(catalog: DataFrame, root: str, levels: Sequence[str]) -> DataFrame:
    """Add the folder names below ``root`` as columns."""
    start = len(re.sub(SCHEME, "", root).rstrip("/")) + 2
    below = F.split(F.substring(F.regexp_replace("path", SCHEME, ""), start, MAX_PATH), "/")
    return catalog.withColumns({name: F.get(below, F.lit(i)) for i, name in enumerate(levels)})


def first_file_per_folder(catalog: DataFrame, path: str = "path") -> DataFrame:
    """The first file of each folder in path order."""
    return catalog.groupBy(parent_dir(F.col(path)).alias("folder")).agg(
        F.min(path).alias("first_file")
    )


def files_per_folder(catalog: DataFrame, path: str = "path") -> DataFrame:
    """How many files each folder holds."""
    return catalog.groupBy(parent_dir(F.col(path)).alias("folder")).agg(
        F.count(F.lit(1)).alias("n_files")
    )


def exclude_paths(catalog: DataFrame, paths: Sequence[str], path: str = "path") -> DataFrame:
    """Leave out a few known stray files."""
    return catalog.filter(~F.col(path).isin(*paths))


def by_extension(catalog: DataFrame, extension: str, path: str = "path") -> DataFrame:
    """Files with a suffix, in path order."""
    return catalog.filter(F.col(path).endswith(extension)).orderBy(path)


def folder_summary(
    scans: DataFrame, keys: Sequence[str], scan: str, annotated: str
) -> DataFrame:
    """Per patient and timepoint: number of scans and whether any is annotated."""
    return scans.groupBy(*keys).agg(
        F.countDistinct(scan).alias("n_scans"), F.bool_or(annotated).alias("any_annotation")
    )


def check_paths_exist(cases: DataFrame, directory: str, catalog: DataFrame) -> DataFrame:
    """Cases whose directory holds no catalogued file: a report, not an error."""
    folders = catalog.select(parent_dir(F.col("path")).alias(directory)).distinct()
    return join_aggregated(cases, folders, [directory], "left_anti")
