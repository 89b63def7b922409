"""Bootstrap confidence intervals of ranking metrics.

``bootstrap_exact`` resamples rows by index; its draws come from a hash, so any engine can repeat
them. It moves a number per draw and a byte per replicate, row and year.

``bootstrap_cells`` draws how often each distinct (score, label) cell is chosen, which has the same
distribution. It costs replicates x cells, never replicates x rows, and is the form for large data.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cohortscope.operators.draws import drawn_rows
from cohortscope.operators.evaluation import score_cells
from cohortscope.operators.joint_bootstrap import bootstrap_counted
from cohortscope.operators.prefix import (
    RANGE_COLUMN,
    place_in_ranges,
    with_row_index,
)
from cohortscope.operators.survival import tidy_metrics

# Cells x replicates drawn at a time: bounds the memory of a task and keeps arrays in cache.
DRAWS_PER_BLOCK = 200_000
# Ranges, and so tasks, a cell bootstrap is spread over. Part of what fixes its draws, so it doesn't
# follow the cluster; a caller with very many distinct scores gives more.
CELL_RANGES = 64


def resample_rows(df: DataFrame, key: str, n_replicates: int, seed: int) -> DataFrame:
    """``n_replicates`` resamples of the table, n of n with replacement, tagged ``replicate``.

    Rows are numbered along the unique ``key``, and n is the number of rows so numbered: rows without
    a key are neither drawn nor counted. Draws are generated by the rows themselves and find
    their row by an equi join on the index.
    """
    indexed = with_row_index(df, key)
    draws = drawn_rows(indexed, n_replicates, seed)
    rows = indexed.withColumnRenamed("row_index", "drawn").drop("n_rows")
    return draws.join(rows, "drawn").drop("drawn")


def bootstrap_exact(
    df: DataFrame,
    key: str,
    scores: Sequence[str],
    time: str,
    event: str,
    n_replicates: int,
    seed: int = 42,
    with_c_index: bool = False,
) -> DataFrame:
    """``replicate``, ``year``, ``metric``, ``value``; replicates lacking a class in a year are left out.

    The draws are those of ``resample_rows``, but rows stay where they are: each takes along how often every replicate
    draws it, and is walked once per year. ``with_c_index`` adds the
    concordance of each replicate (``year`` NULL), weighted by the censoring distribution of the
    whole cohort.
    """
    return bootstrap_counted(df, key, scores, time, event, n_replicates, seed, with_c_index)


def _draw_ranges(rng, plan: list, n_rows: int, n_replicates: int) -> tuple:
    """Positives and negatives drawn from each range, highest scores first, per replicate."""
    ranges = [r[RANGE_COLUMN] for r in plan][::-1]
    pos = np.array([r["pos"] for r in plan], dtype=np.int64)[::-1]
    neg = np.array([r["neg"] for r in plan], dtype=np.int64)[::-1]
    rest = n_rows - pos.sum() - neg.sum()
    weights = np.concatenate([pos, neg, [rest]]).astype(float)
    drawn = rng.multinomial(n_rows, weights / weights.sum(), size=n_replicates)
    k = len(ranges)
    return ranges, pos, neg, drawn[:, :k], drawn[:, k : 2 * k]


def _split(rng, counts: np.ndarray, block: np.ndarray, rest: int) -> np.ndarray:
    """Of ``counts`` draws per replicate, how many fall on each cell of the block; rest stays."""
    if block.sum() == 0:
        return np.zeros((len(counts), len(block)), dtype=np.int64)
    # The last weight takes what the others leave, so it is a real cell once nothing lies beyond.
    filled = np.flatnonzero(block)
    weights = block[filled] if rest == 0 else np.append(block[filled], rest)
    drawn = rng.multinomial(counts, weights / weights.sum())
    out = np.zeros((len(counts), len(block)), dtype=np.int64)
    out[:, filled] = drawn[:, : len(filled)]
    return out


def bootstrap_cells(
    df: DataFrame,
    score: str,
    label: str,
    n_replicates: int,
    seed: int = 42,
    by: Sequence[str] = (),
    n_rows: DataFrame | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Same columns as ``bootstrap_exact`` (``replicate``, ``by``, ``metric``, ``value``) at scale.

    Drawing n of n rows is a multinomial draw over cells, and a multinomial splits exactly: first
    over ranges of scores, then over the cells inside a range. Every task repeats the small first
    draw from the same seed and then walks through its own range only, a block of cells at a time.
    The draws depend on the data, ``seed`` and ``ranges`` alone.

    ``n_rows`` (columns ``by``, ``n_rows``) gives the size of the resample where it exceeds the
    labelled rows, as when cases censored early count in the draw but not in the metric.
    """
    by = list(by)
    ranges = ranges or CELL_RANGES
    placed = place_in_ranges(score_cells(df, score, label, by), "threshold", by, ranges)
    per_range = placed.groupBy(*by, RANGE_COLUMN).agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
    # At most one entry per range, whatever the number of cells or rows.
    entry = F.struct(RANGE_COLUMN, "pos", "neg")
    plan = per_range.groupBy(*by).agg(
        F.sort_array(F.collect_list(entry)).alias("plan"),
        F.sum(F.col("pos") + F.col("neg")).alias("n_rows"),
    )
    if n_rows is not None and by:
        plan = plan.drop("n_rows").join(n_rows, by)
    elif n_rows is not None:
        plan = plan.withColumn("n_rows", n_rows.select("n_rows").scalar())
    # Each range starts with a row of its own that carries the plan.
    heads = plan.select(*by, "plan", "n_rows", F.explode(f"plan.{RANGE_COLUMN}").alias(RANGE_COLUMN))
    rows = placed.unionByName(heads, allowMissingColumns=True)
    # Named partitions give each task one range of every group; hashing a few hundred ranges would
    # pile some of them up.
    home = F.pmod(F.hash(*by, F.lit(0)) + F.col(RANGE_COLUMN), F.lit(ranges))
    batches = rows.repartitionById(ranges, home).sortWithinPartitions(
        *by, F.col(RANGE_COLUMN), F.col("plan").isNull(), F.col("threshold").desc()
    )
    group_fields = [f for f in df.schema.fields if f.name in by]
    group_fields.sort(key=lambda f: by.index(f.name))
    out = T.StructType(
        [T.StructField("replicate", T.IntegerType()), *group_fields]
        + [T.StructField(n, T.DoubleType()) for n in ("won", "areas", "steps", "n_pos", "n_neg")]
    )

    width = max(1, DRAWS_PER_BLOCK // n_replicates)
    kinds = to_arrow_schema(out)

    def resample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            pos, neg = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("pos", "neg"))
            starts = np.flatnonzero(batch.column("plan").is_valid())
            pieces = [0, *starts[starts > 0], batch.num_rows]
            for start, stop in pairwise(pieces):
                if start in starts:
                    if state is not None:
                        yield _close_range(state, by, n_replicates, kinds)
                    head = batch.slice(start, 1).to_pylist()[0]
                    state = _open_range(head, [head[c] for c in by], seed, n_replicates)
                    start += 1
                for low in range(start, stop, width):
                    cut = slice(low, min(low + width, stop))
                    _add_block(state, pos[cut].astype(np.int64), neg[cut].astype(np.int64))
        if state is not None:
            yield _close_range(state, by, n_replicates, kinds)

    partial = batches.mapInArrow(resample, out)
    total = partial.groupBy("replicate", *by).agg(
        *[F.sum(c).alias(c) for c in ("won", "areas", "steps")],
        F.max("n_pos").alias("n_pos"),
        F.max("n_neg").alias("n_neg"),
    )
    wide = total.filter("n_pos > 0 AND n_neg > 0").select(
        "replicate",
        *by,
        (F.col("won") / (F.col("n_pos") * F.col("n_neg"))).alias("auroc"),
        (F.col("areas") / F.col("n_pos")).alias("auprc"),
        (F.col("steps") / F.col("n_pos")).alias("average_precision"),
    )
    return tidy_metrics(wide, ["replicate", *by])


def _open_range(head: dict, group: list, seed: int, n_replicates: int) -> dict:
    """Counts a range starts from, in every replicate."""
    plan, n_rows, range_id = head["plan"], head["n_rows"], head[RANGE_COLUMN]
    shared = [seed, *[int.from_bytes(str(g).encode(), "little") for g in group]]
    ranges, pos, neg, drawn_pos, drawn_neg = _draw_ranges(
        np.random.default_rng(shared), plan, n_rows, n_replicates
    )
    at = ranges.index(range_id)
    return {
        "group": group,
        "rng": np.random.default_rng([*shared, range_id + 1]),
        "tp": drawn_pos[:, :at].sum(axis=1).astype(float),
        "fp": drawn_neg[:, :at].sum(axis=1).astype(float),
        "draws_pos": drawn_pos[:, at].copy(),
        "draws_neg": drawn_neg[:, at].copy(),
        "left_pos": int(pos[at]),
        "left_neg": int(neg[at]),
        "n_pos": drawn_pos.sum(axis=1).astype(float),
        "n_neg": drawn_neg.sum(axis=1).astype(float),
        "won": np.zeros(n_replicates),
        "areas": np.zeros(n_replicates),
        "steps": np.zeros(n_replicates),
    }


def _close_range(state: dict, by: Sequence[str], n_replicates: int, kinds: pa.Schema) -> pa.RecordBatch:
    """The range's share of the metric sums, one row per replicate."""
    columns = {"replicate": np.arange(n_replicates, dtype=np.int32)}
    columns.update({c: [v] * n_replicates for c, v in zip(by, state["group"], strict=True)})
    columns.update({c: state[c] for c in ("won", "areas", "steps", "n_pos", "n_neg")})
    return pa.RecordBatch.from_pydict(columns, schema=kinds)


def _add_block(state: dict, pos: np.ndarray, neg: np.ndarray) -> None:
    """Draw the block's cells in all replicates and add their share of the metric sums."""
    state["left_pos"] -= int(pos.sum())
    state["left_neg"] -= int(neg.sum())
    drawn_pos = _split(state["rng"], state["draws_pos"], pos, state["left_pos"])
    drawn_neg = _split(state["rng"], state["draws_neg"], neg, state["left_neg"])
    state["draws_pos"] = state["draws_pos"] - drawn_pos.sum(axis=1)
    state["draws_neg"] = state["draws_neg"] - drawn_neg.sum(axis=1)
    tp = state["tp"][:, None] + np.cumsum(drawn_pos, axis=1)
    fp = state["fp"][:, None] + np.cumsum(drawn_neg, axis=1)
    before_tp, before_fp = tp - drawn_pos, fp - drawn_neg
    with np.errstate(invalid="ignore", divide="ignore"):
        after = np.where(tp + fp > 0, tp / (tp + fp), 1.0)
        before = np.where(before_tp + before_fp > 0, before_tp / (before_tp + before_fp), 1.0)
    state["won"] += (drawn_neg * (tp - drawn_pos / 2.0)).sum(axis=1)
    state["areas"] += (drawn_pos * (after + before) / 2.0).sum(axis=1)
    state["steps"] += (drawn_pos * after).sum(axis=1)
    state["tp"], state["fp"] = tp[:, -1], fp[:, -1]


def metric_ci(
    values: DataFrame,
    keys: Sequence[str] = ("year", "metric"),
    lower: float = 0.025,
    upper: float = 0.975,
) -> DataFrame:
    """Mean and percentile interval per key over the replicates.

    A group holds one value per replicate (thousands), so Spark's exact ``percentile`` fits.
    """
    bounds = F.percentile("value", F.array(F.lit(lower), F.lit(upper)))
    return values.groupBy(*keys).agg(
        F.count("value").alias("n_replicates"),
        F.avg("value").alias("mean"),
        F.get(bounds, F.lit(0)).alias("lower_bound"),
        F.get(bounds, F.lit(1)).alias("upper_bound"),
    )
