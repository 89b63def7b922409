"""Directory paths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def year_from_path(path: Column) -> Column:
    """Year of the first ``dd-dd-yyyy`` in the path, NULL where there is none."""
    return F.regexp_extract(path, r"\d{2}-\d{2}-(\d{4})", 1).try_cast("int")


def parent_dir(path: Column) -> Column:
    """The path without its last component."""
    return F.regexp_replace(path, "/[^/]*$", "")


def path_component(path: Column, position: int) -> Column:
    """Component counted from the end (-1 is the last); repeated and trailing slashes are ignored."""
    return F.try_element_at(F.split(F.rtrim(path, F.lit("/")), "/+"), F.lit(position))


def path_suffixes(path: Column) -> tuple[Column, Column]:
    """The last ``-`` token of the second-to-last component and of the last component."""
    return tuple(F.substring_index(path_component(path, p), "-", -1) for p in (-2, -1))


def rewrite_prefix(path: Column, old: str, new: str) -> Column:
    """Replace an old root by a new one, literally."""
    return F.replace(path, F.lit(old), F.lit(new))


def join_path(root: str, path: Column) -> Column:
    """Put a relative (``./a``) or rooted (``/a``) path below ``root``."""
    return F.concat_ws("/", F.lit(root.rstrip("/")), F.regexp_replace(path, r"^\.?/", ""))


def zero_pad_path(root: str, prefix: str, number: Column, extension: str, width: int = 4) -> Column:
    """``root/prefix0042.ext``; longer numbers keep all their digits."""
    return F.format_string(f"{root}/{prefix}%0{width}d{extension}", number)
