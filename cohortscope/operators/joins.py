"""Joins between cases, clinical tables and file catalogues.

No side carries a broadcast hint. Spark broadcasts a side by itself when its size, estimated or
measured at run time, is below ``spark.sql.autoBroadcastJoinThreshold``; above it the join is a
sort-merge join whose hot partitions adaptive execution splits (see ``skew``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortscope.operators.skew import join_aggregated


#: Fragment pairs of a key that each of its folders is tested against, and the longest grams of an index of names.
DIRECT = 64
GRAM = 4


def join_clinical(cases: DataFrame, clinical: DataFrame, on: str = "pid") -> DataFrame:
    """All cases with the clinical columns of their subject.

    The clinical table may be derived, and so already lie by subject; hot subjects are still split.
    """
    return join_aggregated(cases, clinical, [on], "left")


def join_outcome(
    cases: DataFrame, outcomes: DataFrame, left_key: str, right_key: str, columns: Sequence[str]
) -> DataFrame:
    """All cases with chosen outcome columns of a table that names its key differently."""
    right = outcomes.select(F.col(right_key).alias("_right_key"), *columns)
    return cases.join(right, F.col(left_key) == F.col("_right_key"), "left").drop("_right_key")


def join_suffixed(
    left: DataFrame,
    right: DataFrame,
    on: str,
    suffixes: tuple[str, str] = ("_x", "_y"),
    how: str = "left",
) -> DataFrame:
    """Join two tables that share more column names than the key; both sides get a suffix there."""
    shared = (set(left.columns) & set(right.columns)) - {on}
    left = left.withColumnsRenamed({c: f"{c}{suffixes[0]}" for c in shared})
    right = right.withColumnsRenamed({c: f"{c}{suffixes[1]}" for c in shared})
    return join_aggregated(left, right, [on], how)


def distinct_keys(df: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]).distinct()


def semi_by_key(df: DataFrame, other: DataFrame, key: str, other_key: str | None = None) -> DataFrame:
    """Rows whose key occurs in ``other``. Its keys are made distinct before the shuffle."""
    return join_aggregated(df, distinct_keys(other, [other_key or key], [key]), [key], "left_semi")


def anti_by_key(df: DataFrame, other: DataFrame, key: str, other_key: str | None = None) -> DataFrame:
    """Rows whose key does not occur in ``other``; a NULL key in ``other`` removes nothing."""
    return join_aggregated(df, distinct_keys(other, [other_key or key], [key]), [key], "left_anti")


def missing_keys(wanted: DataFrame, df: DataFrame, key: str, df_key: str | None = None) -> DataFrame:
    """Requested keys that ``df`` does not hold."""
    return anti_by_key(wanted.select(key), df, key, df_key)


def join_ci(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Inner join on keys that differ in case only; one row per match, left key kept.

    Matches stay rows: a list per key would pull a whole group into one value.
    """
    right = right.withColumn("_folded", F.lower(right_key))
    if left_key == right_key:
        right = right.drop(right_key)
    return left.join(right, F.lower(left[left_key]) == F.col("_folded")).drop("_folded")


def resolve_by_accession(
    cases: DataFrame, catalog: DataFrame, keys: Sequence[str], path: str = "path"
) -> DataFrame:
    """First catalogue path (in path order) with the case's keys, NULL if there is none.

    The catalogue is reduced to one path per key before the join, so no case meets more than one row.
    """
    first = catalog.groupBy(*keys).agg(F.min(path).alias("resolved_path"))
    return join_aggregated(cases, first, keys, "left")


def _grams(text: str, size: Column) -> Column:
    """All distinct stretches of ``size`` characters in ``text``: at most as many as it is long, none if it is shorter."""
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    cut = F.transform(starts, lambda i: F.substring(F.col(text), i, size))
    return F.when(F.length(text) >= size, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


def _sided_grams(outer: str, inner: str) -> Column:
    """(side, gram) of both names, as one array to explode."""

    def sided(name: str, size: str, side: int) -> Column:
        return F.transform(_grams(name, F.col(size)), lambda g: F.struct(F.lit(side).alias("_side"), g.alias("_gram")))

    return F.concat(sided(outer, "_outer_size", 0), sided(inner, "_inner_size", 1))


def _look_up(folders: DataFrame, wanted: DataFrame, gram: int) -> DataFrame:
    """Pairs of wanted fragments and folders that contain them, by an inverted index of the folders' grams.

    Grams of a key are as long as its shortest fragment, ``gram`` at most. Every fragment pair is looked up once, by
    the rarest of its grams, and what the index gives is tested on the names.
    """
    sizes = wanted.groupBy("_key").agg(
        *[F.least(F.lit(gram), F.min(F.length(f))).alias(f"{f}_size") for f in ("_outer", "_inner")]
    )
    entry = ["_key", "_side", "_gram"]
    index = join_aggregated(folders, sizes, ["_key"]).select(
        "_key", "_outer_name", "_inner_name", "_path", F.inline(_sided_grams("_outer_name", "_inner_name"))
    )
    frequency = index.groupBy(*entry).agg(F.count(F.lit(1)).alias("_n"))
    asked = join_aggregated(wanted, sizes, ["_key"]).select(
        "_key", "_outer", "_inner", F.inline(_sided_grams("_outer", "_inner"))
    )
    known = join_aggregated(asked, frequency, entry, "left")
    rank = F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_side", "_gram")
    rarest = known.groupBy("_key", "_outer", "_inner").agg(F.min(rank).alias("_best"))
    rarest = rarest.filter("_best.n > 0").select("_key", "_outer", "_inner", "_best._side", "_best._gram")
    return _contained(index.join(rarest, entry))


def _contained(pairs: DataFrame) -> DataFrame:
    both = F.contains("_outer_name", "_outer") & F.contains("_inner_name", "_inner")
    return pairs.filter(both).select("_key", "_outer", "_inner", "_path")


def resolve_by_suffix(
    cases: DataFrame,
    catalog: DataFrame,
    key: str,
    outer: tuple[str, str],
    inner: tuple[str, str],
    path: str = "path",
    direct: int = DIRECT,
    gram: int = GRAM,
) -> DataFrame:
    """Find each case's folder by two fragments of its name.

    ``outer`` and ``inner`` pair a fragment column of ``cases`` with the folder-name column of
    ``catalog`` it must occur in. A case matches the folders of its own ``key`` that contain both.
    Adds ``resolved_path`` (first in path order or NULL), ``n_matches`` and ``match_status``
    (``none``, ``unique`` or ``multiple``).

    The folders of a key with at most ``direct`` fragment pairs are tested against each of them. Beyond that the tests
    would grow with the square of the group, and fragments are looked up in an inverted index of the folder names'
    grams, which has at most a row for each character of a name. Which keys there are is found out at once.
    """
    (outer_want, outer_name), (inner_want, inner_name) = outer, inner
    wanted = (
        cases.select(
            F.col(key).alias("_key"),
            F.col(outer_want).alias("_outer"),
            F.col(inner_want).alias("_inner"),
        )
        .dropna()
        .distinct()
    )
    folders = catalog.select(
        F.col(key).alias("_key"),
        F.col(outer_name).alias("_outer_name"),
        F.col(inner_name).alias("_inner_name"),
        F.col(path).alias("_path"),
    ).dropna(subset=["_key", "_outer_name", "_inner_name"])
    # Each way to search shuffles the folders anew, so a way that no key needs is left out. A key with few rows has few
    # pairs, and counting rows costs less than counting pairs.
    often = cases.groupBy(key).count().filter(F.col(key).isNotNull() & (F.col("count") > direct))
    if often.isEmpty():
        hits = _contained(folders.join(wanted, "_key"))
    else:
        load = wanted.groupBy("_key").agg((F.count(F.lit(1)) > direct).alias("_large"))
        sized = join_aggregated(wanted, load, ["_key"])
        few, many = (sized.filter(c).drop("_large") for c in (~F.col("_large"), F.col("_large")))
        hits = _contained(folders.join(few, "_key")).unionAll(_look_up(folders, many, gram))
    found = hits.groupBy("_key", "_outer", "_inner").agg(
        F.min("_path").alias("resolved_path"), F.count(F.lit(1)).alias("_matches")
    )
    found = found.withColumnsRenamed({"_key": key, "_outer": outer_want, "_inner": inner_want})
    matched = join_aggregated(cases, found, [key, outer_want, inner_want], "left")
    n_matches = F.coalesce("_matches", F.lit(0))
    status = F.when(n_matches == 0, "none").when(n_matches == 1, "unique").otherwise("multiple")
    return matched.select(
        *cases.columns,
        "resolved_path",
        n_matches.alias("n_matches"),
        status.alias("match_status"),
    )
