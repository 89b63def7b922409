"""Draws of rows with replacement that any engine can repeat, as rows and as counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortscope.operators.prefix import default_ranges

#: Counts (rows x replicates) that a task tallies at once, and that leave it in one batch.
COUNTS_PER_TASK = 8_000_000
COUNTS_PER_BATCH = 2_000_000


def draw_index(seed: int, replicate, position, n_rows):
    """Row index of draw ``position`` in ``replicate``: 32 hash bits modulo the number of rows."""
    text = F.concat_ws("-", F.lit(str(seed)), replicate.cast("string"), position.cast("string"))
    bits = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    return bits % n_rows


def drawn_rows(indexed: DataFrame, n_replicates: int, seed: int) -> DataFrame:
    """``replicate`` and ``drawn``, a row per draw: every row of ``indexed`` makes one in each replicate."""
    replicates = F.explode(F.sequence(F.lit(0), F.lit(n_replicates - 1)))
    return indexed.select("row_index", "n_rows", replicates.alias("replicate")).select(
        "replicate",
        draw_index(seed, F.col("replicate"), F.col("row_index"), F.col("n_rows")).alias("drawn"),
    )


def count_bytes(counts: np.ndarray) -> bytes:
    """One row's counts, a byte each where they all fit and eight otherwise."""
    return counts.astype(np.uint8 if counts.max() < 256 else "<i8").tobytes()


def counts_of(column: pa.Array, n_replicates: int) -> np.ndarray:
    """What ``count_bytes`` wrote, a row per value."""
    values = column.to_pylist()
    if all(len(v) == n_replicates for v in values):
        return np.frombuffer(b"".join(values), np.uint8).reshape(-1, n_replicates)
    return np.stack([np.frombuffer(v, np.uint8 if len(v) == n_replicates else "<i8").astype(np.int64) for v in values])


def draw_counts(indexed: DataFrame, n: int, n_replicates: int, seed: int) -> DataFrame:
    """``row_index`` and ``counts``: how often each replicate draws the row. Rows never drawn are left out.

    The draws of ``drawn_rows`` travel as one number each to the task that tallies their row.
    """
    tasks = max(default_ranges(indexed), -(-n * n_replicates // COUNTS_PER_TASK))
    width = max(1, -(-n // tasks))
    size = width * n_replicates

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies: dict[int, np.ndarray] = {}
        for batch in batches:
            cell = batch.column(0).to_numpy()
            place = cell // size
            for p in np.unique(place).tolist():
                if p not in tallies:
                    tallies[p] = np.zeros(size, np.uint32)
                np.add.at(tallies[p], cell[place == p] - p * size, np.uint32(1))
        step = max(1, COUNTS_PER_BATCH // n_replicates)
        for p, counts in tallies.items():
            counts = counts.reshape(width, n_replicates)
            filled = np.flatnonzero(counts.any(axis=1))
            for low in range(0, len(filled), step):
                rows = filled[low : low + step]
                packed = pa.array([count_bytes(counts[i]) for i in rows], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(p * width + rows), packed], names=["row_index", "counts"])

    # A stored table of few bytes may be one partition, which is few for so many draws.
    spread = indexed.select("row_index", "n_rows").repartition(tasks, "row_index")
    cells = drawn_rows(spread, n_replicates, seed).select((F.col("drawn") * n_replicates + F.col("replicate")).alias("cell"))
    home = F.floor(F.col("cell") / F.lit(size)).cast("int")
    return cells.repartitionById(tasks, home).mapInArrow(tally, "row_index long, counts binary")
