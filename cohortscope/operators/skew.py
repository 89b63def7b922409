"""Joining an aggregated table back to rows whose keys may be hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD = "_shard"
N_SHARDS = 4096


def join_aggregated(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join ``right``, a table aggregated by ``keys``, so that hot keys of ``left`` can be split.

    Adaptive execution splits a skewed partition only where the join reads both sides straight from
    a shuffle. A side aggregated by the join's own key has its rows in place already and is read
    without one, and a hot key would stay in one task. A join column derived from the key makes
    Spark shuffle that side, which is small, once more.
    """
    keys = list(keys)
    if any(left.schema[k].dataType != right.schema[k].dataType for k in keys):
        return left.join(right, keys, how)
    shard = F.pmod(F.xxhash64(*keys), F.lit(N_SHARDS))
    joined = left.withColumn(SHARD, shard).join(right.withColumn(SHARD, shard), [*keys, SHARD], how)
    return joined.drop(SHARD)
