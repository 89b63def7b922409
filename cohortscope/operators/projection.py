"""Filters and column changes that need more than one DataFrame method."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_numeric(text: Column) -> Column:
    """A number, or NULL where the text is none."""
    return text.try_cast("double")


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in which all ``columns`` hold a value; NaN counts as missing.

    Unlike ``dropna`` this is said in comparisons that a scan can use to skip data.
    """
    for name in columns:
        df = df.filter(F.col(name).isNotNull())
        if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
            df = df.filter(~F.isnan(name))
    return df


def drop_sentinels(df: DataFrame, columns: Sequence[str], sentinels: Sequence[str]) -> DataFrame:
    """Rows whose ``columns`` hold neither NULL nor a sentinel text."""
    for name in columns:
        text = F.col(name).cast("string")
        df = df.filter(text.isNotNull() & ~text.isin(*sentinels))
    return df


def max_bound(df: DataFrame, column: str, bound: float) -> DataFrame:
    """Rows with a number up to ``bound``; text that is no number counts as missing.

    A column of numbers is compared as it is, which a scan can use to skip data.
    """
    if isinstance(df.schema[column].dataType, T.NumericType):
        return df.filter((F.col(column) <= bound) & ~F.isnan(F.col(column).cast("double")))
    return df.filter(to_numeric(F.col(column).cast("string")) <= bound)


def in_list(df: DataFrame, column: str, values: Sequence | DataFrame) -> DataFrame:
    """Rows whose value is listed: in a sequence that becomes part of the plan, or in a one-column table."""
    if isinstance(values, DataFrame):
        return df.join(values.toDF(column), column, "left_semi")
    return df.filter(F.col(column).isin(*values))


def map_values(column: Column, mapping: Mapping) -> Column:
    """Look up each value in a small dictionary; NULL where it has no entry."""
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.try_element_at(pairs, column)
