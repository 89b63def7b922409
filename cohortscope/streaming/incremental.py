"""Score case files as they arrive, each exactly once.

The batch form is ``operators.scoring.score_resume``. Here the query's checkpoint is the record of
what is done: files already scored are not read again, and the parquet sink commits each batch once
even if executors or the driver are lost on the way. With a ``key`` the checkpoint also holds the keys
seen, so a case that comes again, in the same file, another one or a replayed delivery, is scored once.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from cohortscope.operators.observed import require_not_null
from cohortscope.operators.scoring import Loader, score_cases
from cohortscope.schemas import N_YEARS


def score_new_files(
    spark: SparkSession,
    cases_path: str,
    schema: T.StructType,
    done_path: str,
    checkpoint: str,
    load_model: Loader,
    years: int = N_YEARS,
    files_per_batch: int = 1000,
    key: str | None = None,
) -> StreamingQuery:
    """Start a query that scores all files not seen before and then stops.

    ``key`` names a column that tells cases apart: the first row of a key is scored, later ones are passed
    over, and a row without a key fails the query. Keys are state, spread over tasks by hash and kept with the
    checkpoint; they stay for good, so give the session the RocksDB state store when they are many. Use it from the first
    run of a checkpoint on.
    """
    cases = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(cases_path)
    )
    if key is not None:
        cases = require_not_null(cases, [key]).dropDuplicates([key])
    return (
        score_cases(cases, load_model, years)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(done_path)
    )
