"""Reading case, clinical and score tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts that stand for a missing value in exported tables.
SENTINELS = ("missing", "None")


def quoted(name: str) -> str:
    """Column reference for headers with blanks, dots, slashes or stars."""
    return "`" + name.replace("`", "``") + "`"


def null_if_missing(
    df: DataFrame, sentinels: Sequence[str] = SENTINELS, columns: Sequence[str] | None = None
) -> DataFrame:
    """Turn sentinel texts and NaN into NULL (Spark sorts NaN above every number)."""
    projected = []
    for field in df.schema.fields:
        column = F.col(quoted(field.name))
        if columns is None or field.name in columns:
            if isinstance(field.dataType, T.StringType):
                column = F.when(~column.isin(*sentinels), column)
            elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
                column = F.when(~F.isnan(column), column)
        projected.append(column.alias(field.name))
    return df.select(*projected)


def read_cases(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    sentinels: Sequence[str] = SENTINELS,
    drop_malformed: bool = False,
) -> DataFrame:
    """Headered CSV with quoted commas and doubled quotes; a byte-order mark is skipped.

    Give a ``schema`` for anything large: without one Spark reads the input twice to infer it.
    """
    reader = spark.read.option("header", True).option("escape", '"')
    if drop_malformed:
        reader = reader.option("mode", "DROPMALFORMED")
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return null_if_missing(reader.csv(path), sentinels)


def read_indexed_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV whose first column is a row index; the index is dropped."""
    df = read_cases(spark, path, schema)
    return df.drop(df.columns[0])


def read_json_map(
    spark: SparkSession,
    path: str,
    value_schema: T.DataType,
    key: str = "series",
    whole_document: bool = False,
) -> DataFrame:
    """JSON objects ``{key: value, ..}`` to one row per key.

    Each line holds one object. With ``whole_document`` each file is one (possibly indented) object;
    such a file cannot be split over tasks, so prefer lines for anything large.
    """
    document = spark.read.text(path, wholetext=whole_document)
    entries = F.from_json("value", T.MapType(T.StringType(), value_schema))
    return document.select(F.explode(entries).alias(key, "annotation"))


def inline_cases(spark: SparkSession, rows: Iterable[tuple], schema: T.StructType | str) -> DataFrame:
    """Literal rows or ids as a table."""
    return spark.createDataFrame(list(rows), schema)


def normalize_headers(
    df: DataFrame, tags: Mapping[str, str] | Sequence[str], placeholder: str = "missing"
) -> DataFrame:
    """Header tags as text with ``placeholder`` for absent ones; other columns are kept.

    ``tags`` lists tag columns or maps source names to output names. A tag the table does not have
    at all is filled with the placeholder.
    """
    names = dict(tags) if isinstance(tags, Mapping) else {t: t for t in tags}
    others = [F.col(quoted(c)) for c in df.columns if c not in names]
    filled = []
    for source, target in names.items():
        if source in df.columns:
            filled.append(
                F.coalesce(F.col(quoted(source)).cast("string"), F.lit(placeholder)).alias(target)
            )
        else:
            filled.append(F.lit(placeholder).alias(target))
    return df.select(*others, *filled)
