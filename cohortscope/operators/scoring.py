"""Batch scoring with a user-supplied model, resumable after an interruption."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortscope.operators.joins import anti_by_key, semi_by_key
from cohortscope.operators.observed import require_not_null
from cohortscope.schemas import N_YEARS, score_columns
from cohortscope.session import scratch_dir

# A loader runs once per worker and returns predict(batch) -> scores, an (n, years) array.
Loader = Callable[[], Callable[[pd.DataFrame], np.ndarray]]
# The same with features: predict(batch) -> (scores, features).
FeatureLoader = Callable[[], Callable[[pd.DataFrame], tuple[np.ndarray, np.ndarray]]]


def score_cases(df: DataFrame, load_model: Loader, years: int = N_YEARS) -> DataFrame:
    """Add one score column per year. The model is loaded once per task, not once per row."""
    names = score_columns(years)
    schema = T.StructType(df.schema.fields + [T.StructField(n, T.DoubleType()) for n in names])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = load_model()
        for batch in batches:
            scores = np.asarray(predict(batch), dtype=float).reshape(len(batch), years)
            yield batch.assign(**{n: scores[:, i] for i, n in enumerate(names)})

    return df.mapInPandas(run, schema)


def score_with_features(df: DataFrame, load_model: FeatureLoader, years: int = N_YEARS) -> DataFrame:
    """Add the score columns and a ``features`` array from the same model call."""
    names = score_columns(years)
    extra = [T.StructField(n, T.DoubleType()) for n in names]
    extra.append(T.StructField("features", T.ArrayType(T.DoubleType())))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = load_model()
        for batch in batches:
            scores, features = predict(batch)
            scores = np.asarray(scores, dtype=float).reshape(len(batch), years)
            added = {n: scores[:, i] for i, n in enumerate(names)}
            yield batch.assign(**added, features=list(np.asarray(features, dtype=float)))

    return df.mapInPandas(run, T.StructType(df.schema.fields + extra))


def unscored(df: DataFrame, score: str = "pred_risk_year_0") -> DataFrame:
    """Rows still without a score."""
    return df.filter(F.col(score).isNull() | F.isnan(score))


def scored_so_far(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows written to ``path`` by earlier runs; empty if there are none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def score_resume(
    todo: DataFrame,
    done_path: str,
    key: str,
    load_model: Loader | FeatureLoader,
    years: int = N_YEARS,
    n_chunks: int = 1,
    features: bool = False,
) -> DataFrame:
    """Score the cases that ``done_path`` does not hold yet and return all of ``todo``.

    With ``features`` the model is one that returns (scores, features), and both are stored.

    The remaining cases are taken in ``n_chunks`` hash chunks of their unique key and appended chunk
    by chunk, so an interrupted run loses one chunk at most and the next run, with any number of
    chunks, carries on from the rows it finds. A row without a key can't be found again, so it fails
    the first job, before anything is scored.
    """
    spark = todo.sparkSession
    todo = require_not_null(todo, [key])
    added = [T.StructField(n, T.DoubleType()) for n in score_columns(years)]
    if features:
        added.append(T.StructField("features", T.ArrayType(T.DoubleType())))
    schema = T.StructType(todo.schema.fields + added)
    score = score_with_features if features else score_cases
    # The keys left are found once and stored in chunks, so each chunk reads its own part of them.
    left = scratch_dir(spark, "remaining")
    keys = todo.select(key).withColumn("_chunk", F.pmod(F.xxhash64(key), F.lit(n_chunks)).cast("int"))
    done = scored_so_far(spark, done_path, schema)
    anti_by_key(keys, done, key).write.partitionBy("_chunk").parquet(left)
    stored = spark.read.schema(keys.schema).parquet(left)
    for chunk in range(n_chunks):
        part = todo.filter(F.pmod(F.xxhash64(key), F.lit(n_chunks)) == chunk)
        part = semi_by_key(part, stored.filter(F.col("_chunk") == chunk), key)
        score(part, load_model, years).write.mode("append").parquet(done_path)
    return semi_by_key(scored_so_far(spark, done_path, schema), todo, key)
