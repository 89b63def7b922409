"""What the corpus operators share: the registry, tables kept in the shared folder, row keys."""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortscope.session import scratch_dir, ship_package

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
HELD_OUT = 2
FOLDS = 4


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a corpus query, with its SQL where SQL can say the result."""

    def register(function: Query) -> Query:
        @functools.wraps(function)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return function(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers that don't have it installed."""
    ship_package(spark, PACKAGE)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and not lost with an executor."""
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column) -> Column:
    """Whether a row belongs to the fold that models never learn labels from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


def slices(batch: pa.RecordBatch, column: str, max_chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a piece stay near ``max_chars``; one long text is one piece."""
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > max_chars:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield batch.slice(start)


def rebatched(batches: Iterator[pa.RecordBatch], column: str, max_chars: int = 4_000_000):
    """All batches in slices; what Arrow holds in reserve goes back to the system after each."""
    import pyarrow.compute  # noqa: F401  # loads pa.compute

    for batch in batches:
        yield from slices(batch, column, max_chars)
        del batch
        pa.default_memory_pool().release_unused()
