"""Writing results, and computing a table once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def write_cases(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Overwrite ``path`` with the table, as headered CSV or any other Spark format."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.format(fmt).save(path)


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a finished job wrote ``path``: an interrupted one leaves no success marker."""
    try:
        spark.read.format("binaryFile").load(f"{path.rstrip('/')}/_SUCCESS")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def memoize(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Read the table at ``path``; compute and store it first if it is not there yet."""
    if not is_complete(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_by_label(df: DataFrame, path: str, label: str = "outcome", fmt: str = "parquet") -> None:
    """One folder per label value; a finished output is kept, an interrupted one is written again."""
    if not is_complete(df.sparkSession, path):
        df.write.mode("overwrite").partitionBy(label).format(fmt).save(path)
