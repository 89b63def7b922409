"""Bootstrap of all yearly metrics and the C-index from one draw of whole cases, at any size.

A replicate draws n of n cases with replacement, and a case that is drawn counts in every year it is in. How often
replicate b draws case i is a function of the two numbers: a hash gives a Poisson count of mean slightly below
one, and what a replicate then lacks to n is drawn case by case. Given their total, independent Poisson counts are
multinomial, so the sum is exactly the multinomial draw of n of n. (Should a total exceed n, about once in a
thousand million replicates, the replicate's counts are drawn anew.) Hashes are 32-bit integer arithmetic, which any engine
can repeat.

So no draw is ever stored or joined to rows: whichever task holds a case, in whichever year's order, works out its
draws in all replicates. Only the few completed draws travel, about ``6 * sqrt(n)`` a replicate. Cases are sorted by
each year's scores in ranges; a first pass totals the ranges, a second one walks through each range from the
totals of those above it. A task holds ``DRAWS_PER_BLOCK`` draws at a time. Scores that very many cases share are
summed up in parts first, and enter as one row of counts.

Work is replicates x cases x years, spread over tasks; data moved is cases x years.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortscope.operators.draws import counts_of, draw_counts, draw_index
from cohortscope.operators.prefix import RANGE_COLUMN, default_ranges, range_of, range_splits, with_row_index
from cohortscope.operators.projection import drop_missing
from cohortscope.operators.skew import join_aggregated
from cohortscope.operators.survival import censoring_distribution, tidy_metrics
from cohortscope.session import scratch_dir

# Draws worked on at a time, and hashed at a time: both keep arrays in cache.
DRAWS_PER_BLOCK = 200_000
HASHED_AT_ONCE = 80_000
#: Replicates whose totals travel as one row.
BLOCK = 500
#: Cases of one score and year that are summed up in parts.
TIED = 20_000
#: Standard deviations that the Poisson counts' mean total stays below n.
MARGIN = 6
#: The rounds of a 32-bit mixer, and what parts seeds and attempts.
ROUNDS = ((16, 0x7FEB352D), (15, 0x846CA68B))
LAST_SHIFT = 16
APART = 0x9E3779B9
#: More draws of one case than this have a probability under 2**-32.
MOST = 13
#: Counts that are tested for in every hash.
COMMON = 4
#: Scores in a block up to which each is summed by itself.
FEW_CELLS = 4
POS, NEG, FORMER, LATTER = 1, 2, 4, 8


def mix(x: np.ndarray) -> np.ndarray:
    """A 32-bit hash of 32-bit integers."""
    x = x.copy()
    _mix_in_place(x, np.empty_like(x))
    return x


def _mix_in_place(x: np.ndarray, spare: np.ndarray) -> None:
    for shift, factor in ROUNDS:
        np.bitwise_xor(x, np.right_shift(x, np.uint32(shift), out=spare), out=x)
        np.multiply(x, np.uint32(factor), out=x)
    np.bitwise_xor(x, np.right_shift(x, np.uint32(LAST_SHIFT), out=spare), out=x)


def poisson_mean(n: int) -> float:
    return max(0.0, 1 - MARGIN / math.sqrt(n)) if n else 0.0


def thresholds(n: int) -> np.ndarray:
    """A hash stands for as many draws as thresholds it reaches."""
    mean = poisson_mean(n)
    term = total = math.exp(-mean)
    found = []
    for k in range(1, MOST + 1):
        found.append(math.floor(total * 2**32))
        term *= mean / k
        total += term
    return np.array([t for t in found if t < 2**32], np.uint32)


def replicate_keys(seed: int, attempts: np.ndarray) -> np.ndarray:
    """One 32-bit key per replicate; ``attempts`` counts how often each was drawn anew."""
    start = mix(np.array([seed % 2**32], np.uint32))[0]
    with np.errstate(over="ignore"):
        return mix(np.arange(len(attempts), dtype=np.uint32) + start + attempts.astype(np.uint32) * np.uint32(APART))


def hashed_draws(index: np.ndarray, keys: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Poisson counts, a row per case and a column per replicate."""
    low, high = (index & 0xFFFFFFFF).astype(np.uint32), (index >> 32).astype(np.uint32)
    base = mix(low ^ mix(high))
    counts = np.zeros((len(index), len(keys)), np.uint8)
    step = max(1, HASHED_AT_ONCE // len(keys))
    hashes, spare = (np.empty((step, len(keys)), np.uint32) for _ in range(2))
    reached = np.empty(hashes.size, bool)
    for first in range(0, len(index), step):
        part = counts[first : first + step]
        u = np.add(base[first : first + step, None], keys[None, :], out=hashes[: len(part)])
        _mix_in_place(u, spare[: len(part)])
        part, u = part.reshape(-1), u.reshape(-1)
        hit = reached[: len(u)]
        for limit in limits[:COMMON]:
            part += np.greater_equal(u, limit, out=hit).view(np.uint8)
        if len(limits) > COMMON:
            # Few hashes reach a higher limit.
            rare = np.flatnonzero(np.greater_equal(u, limits[COMMON], out=hit))
            part[rare] += np.searchsorted(limits[COMMON:], u[rare], side="right").astype(np.uint8)
    return counts


def _stored(df: DataFrame, label: str) -> DataFrame:
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _totals(keys: np.ndarray, limits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(keys), np.int64)
        step = max(1, DRAWS_PER_BLOCK // len(keys))
        for batch in batches:
            index = batch.column(0).to_numpy()
            for low in range(0, len(index), step):
                total += hashed_draws(index[low : low + step], keys, limits).sum(axis=0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(keys), dtype=np.int32)), pa.array(total)], names=["replicate", "total"])

    return run


def draw_totals(cases: DataFrame, n: int, n_replicates: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Attempts that each replicate takes, and the total of its hashed draws, which is at most n."""
    limits, attempts = thresholds(n), np.zeros(n_replicates, np.int64)
    while True:
        counted = cases.select("row_index").mapInArrow(_totals(replicate_keys(seed, attempts), limits), "replicate int, total long")
        rows = counted.groupBy("replicate").agg(F.sum("total").alias("total")).collect()
        total = np.zeros(n_replicates, np.int64)
        for r in rows:
            total[r.replicate] = r.total
        if (total <= n).all():
            return attempts, total
        attempts[total > n] += 1


def with_completing_draws(cases: DataFrame, total: np.ndarray, n: int, seed: int) -> DataFrame:
    """``cases`` with ``extra``: the replicates that draw a case beyond the hashed draws, once per draw."""
    lacking = cases.sparkSession.createDataFrame([(b, int(n - t)) for b, t in enumerate(total)], "replicate int, lacking long")
    each = lacking.filter("lacking > 0").select("replicate", F.explode(F.sequence(F.lit(0), F.col("lacking") - 1)).alias("j"))
    drawn = each.select("replicate", draw_index(seed, F.col("replicate"), F.col("j"), F.lit(n)).alias("row_index"))
    return cases.join(drawn.groupBy("row_index").agg(F.collect_list("replicate").alias("extra")), "row_index", "left")


def _units(cases: DataFrame, scores: Sequence[str], time: str, event: str) -> DataFrame:
    """One row per case and year with a part in a metric: year, score, role, and what gives its draws.

    The roles add up: ``POS`` and ``NEG`` of the yearly curves, ``FORMER`` (an event of that year) and ``LATTER``
    (observed longer) of the pairs of the C-index.
    """
    entries = []
    for i, score in enumerate(scores):
        positive = (F.col(event) == 1) & (F.col(time) <= i)
        label = F.when(positive, POS).when(F.col(time) >= i, NEG).otherwise(0)
        pair = F.when((F.col(event) == 1) & (F.col(time) == i), FORMER).when(F.col(time) > i, LATTER).otherwise(0)
        entries.append(
            F.struct(F.lit(i + 1).alias("year"), F.col(score).cast("double").alias("score"), (label + pair).alias("role"))
        )
    units = cases.select("row_index", "extra", "counts", F.inline(F.array(*entries)))
    return drop_missing(units.filter("role > 0"), ["score"])


class _Draws:
    """Draws of rows, whether they come as a case, as a case with its counts or as counts of many cases."""

    def __init__(self, n_replicates: int, keys: np.ndarray | None = None, limits: np.ndarray | None = None):
        self.width, self.keys, self.limits = n_replicates, keys, limits
        self.step = max(1, DRAWS_PER_BLOCK // n_replicates)

    def of(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        """Blocks of rows as (first row, draws)."""
        for low in range(0, batch.num_rows, self.step):
            part = batch.slice(low, self.step)
            counts = part.column("counts")
            if counts.null_count == 0:
                yield low, counts_of(counts, self.width)
                continue
            index = part.column("row_index").fill_null(0).to_numpy(zero_copy_only=False)
            drawn = hashed_draws(index, self.keys, self.limits)
            extra = part.column("extra")
            replicates = extra.flatten().to_numpy(zero_copy_only=False)
            if len(replicates):
                row = pc.list_parent_indices(extra).to_numpy(zero_copy_only=False)
                np.add.at(drawn.reshape(-1), row * self.width + replicates, np.uint8(1))
            summed = np.flatnonzero(counts.is_valid().to_numpy(zero_copy_only=False))
            if len(summed):
                drawn = drawn.astype(np.int64)
                drawn[summed] = counts_of(counts.take(pa.array(summed)), self.width)
            yield low, drawn


UNIT = ("year", "score", "role", "row_index", "extra", "counts")


def _condense(units: DataFrame, draws: _Draws, tied: int) -> DataFrame:
    """``units`` with all rows of a year, role and score that ``tied`` rows share replaced by one row of counts."""
    cell = ["year", "score", "role"]
    hot = _stored(units.groupBy(*cell).agg(F.count("*").alias("n")).filter(F.col("n") > tied), "tied-scores")
    if hot.isEmpty():
        return units.select(*UNIT)
    parts = join_aggregated(units, hot, cell).withColumn("part", F.col("row_index") % F.ceil(F.col("n") / tied))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, total = None, None

        def closed() -> pa.RecordBatch:
            year, score, role, _ = open_
            n = len(total)
            columns = {"year": [year] * n, "score": [score] * n, "role": [role] * n, "replicate": np.arange(n), "count": total}
            kinds = pa.schema([("year", pa.int32()), ("score", pa.float64()), ("role", pa.int32()), ("replicate", pa.int32()), ("count", pa.int64())])
            return pa.RecordBatch.from_pydict(columns, schema=kinds)

        for batch in batches:
            names = list(zip(*(batch.column(c).to_pylist() for c in (*cell, "part")), strict=True))
            for low, drawn in draws.of(batch):
                begin = 0
                for i in range(1, len(drawn) + 1):
                    if i < len(drawn) and names[low + i] == names[low + begin]:
                        continue
                    if open_ != names[low + begin]:
                        if open_ is not None:
                            yield closed()
                        open_, total = names[low + begin], np.zeros(drawn.shape[1], np.int64)
                    total = total + drawn[begin:i].sum(axis=0, dtype=np.int64)
                    begin = i
        if open_ is not None:
            yield closed()

    ordered = parts.select(*UNIT, "part").repartition(*cell, "part").sortWithinPartitions(*cell, "part")
    counted = ordered.mapInArrow(summed, "year int, score double, role int, replicate int, count long")
    counted = counted.groupBy(*cell, "replicate").agg(F.sum("count").alias("count"))
    width = draws.width

    def packed(rows: pa.Table) -> pa.Table:
        counts = np.zeros(width, np.int64)
        counts[rows.column("replicate").to_numpy()] = rows.column("count").to_numpy()
        return rows.slice(0, 1).select(cell).append_column("counts", pa.array([counts.tobytes()], pa.binary()))

    vectors = counted.groupBy(*cell).applyInArrow(packed, "year int, score double, role int, counts binary")
    cold = join_aggregated(units, hot.select(*cell), cell, "left_anti")
    return cold.unionByName(_stored(vectors, "tied-draws"), allowMissingColumns=True).select(*UNIT)


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """The batch cut by (year, range)."""
    year, place = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("year", RANGE_COLUMN))
    cuts = np.flatnonzero((np.diff(year) != 0) | (np.diff(place) != 0)) + 1
    for low, high in zip([0, *cuts], [*cuts, len(year)], strict=True):
        if high > low:
            yield (int(year[low]), int(place[low])), batch.slice(low, high - low)


#: A block is named by its first replicate.
TOTALS = f"year int, {RANGE_COLUMN} int, block int, pos binary, neg binary, former binary"
ROLES = (POS, NEG, FORMER, LATTER)


def _role_sums(role: np.ndarray, drawn: np.ndarray, roles: Sequence[int]) -> np.ndarray:
    return np.stack([drawn[role & k > 0].sum(axis=0, dtype=np.int64) for k in roles])


def _range_totals(draws: _Draws):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches come by year and range; one row per range and block of replicates."""
        open_, total = None, None

        def closed() -> pa.RecordBatch:
            cuts = range(0, total.shape[1], BLOCK)
            columns = [pa.array([x] * len(cuts), pa.int32()) for x in open_] + [pa.array(list(cuts), pa.int32())]
            columns += [pa.array([t[c : c + BLOCK].tobytes() for c in cuts], pa.binary()) for t in total]
            return pa.RecordBatch.from_arrays(columns, names=["year", RANGE_COLUMN, "block", "pos", "neg", "former"])

        for batch in batches:
            for group, rows in _groups(batch):
                if group != open_:
                    if open_ is not None:
                        yield closed()
                    open_, total = group, np.zeros((3, draws.width), np.int64)
                role = rows.column("role").to_numpy()
                for low, drawn in draws.of(rows):
                    total += _role_sums(role[low : low + len(drawn)], drawn, ROLES[:3])
        if open_ is not None:
            yield closed()

    return run


def _above(rows: pa.Table) -> pa.Table:
    """Totals of a year's ranges to totals of the ranges above each, for one block of replicates."""
    order = np.argsort(-rows.column(RANGE_COLUMN).to_numpy())
    rows = rows.take(pa.array(order))
    for name in ("pos", "neg", "former"):
        counts = np.stack([np.frombuffer(x, "<i8") for x in rows.column(name).to_pylist()])
        before = np.cumsum(counts, axis=0) - counts
        rows = rows.set_column(rows.schema.get_field_index(name), name, pa.array([x.tobytes() for x in before], pa.binary()))
    return rows


SUMS = ("won", "areas", "steps", "n_pos", "n_neg", "pairs_won", "n_former", "n_latter")


class _Walk:
    """Sums of a range, from the highest score down."""

    def __init__(self, group: tuple[int, int], width: int):
        self.group, self.open = group, None
        self.above = np.zeros((3, width))
        self.sums = {name: np.zeros(width) for name in SUMS}

    def start(self, blocks: list[dict]) -> None:
        for x in blocks:
            counts = np.stack([np.frombuffer(x[name], "<i8") for name in ("pos", "neg", "former")])
            self.above[:, x["block"] : x["block"] + counts.shape[1]] = counts

    def add(self, score: np.ndarray, role: np.ndarray, drawn: np.ndarray) -> None:
        """Rows in falling order, those of a score by role; what has the last score stays open for more of it."""
        cuts = np.flatnonzero(score[1:] != score[:-1]) + 1
        if len(cuts) < FEW_CELLS:
            parts = zip([0, *cuts], [*cuts, len(score)], strict=True)
            counts = np.stack([_role_sums(role[a:b], drawn[a:b], ROLES) for a, b in parts], axis=1).astype(float)
        else:
            counts = self._cells(score, role, drawn)
        if self.open is not None:
            if self.open[0] == score[0]:
                counts[:, 0] += self.open[1]
            else:
                counts = np.concatenate([self.open[1][:, None], counts], axis=1)
        self.open = (score[-1], counts[:, -1].copy())
        self._close(counts[:, :-1])

    @staticmethod
    def _cells(score: np.ndarray, role: np.ndarray, drawn: np.ndarray) -> np.ndarray:
        """Counts by bit of the roles, score and replicate."""
        new = np.concatenate([[True], score[1:] != score[:-1]])
        starts = np.flatnonzero(new | np.concatenate([[True], role[1:] != role[:-1]]))
        if len(starts) < len(score):
            drawn = np.add.reduceat(drawn, starts, axis=0, dtype=np.int32 if drawn.dtype == np.uint8 else np.int64)
        role, cells = role[starts], np.flatnonzero(new[starts])
        counts = np.zeros((4, len(cells), drawn.shape[1]))
        place = np.cumsum(new[starts]) - 1
        for i, k in enumerate(ROLES):
            # Several roles of a score may hold the same bit.
            mine = np.flatnonzero(role & k)
            first = np.concatenate([[True], place[mine[1:]] != place[mine[:-1]]])[: len(mine)]
            counts[i, place[mine[first]]] = drawn[mine[first]]
            for j in mine[~first]:
                counts[i, place[j]] += drawn[j]
        return counts

    def _close(self, counts: np.ndarray) -> None:
        if not counts.shape[1]:
            return
        pos, neg, former, latter = counts
        tp, fp, before = (self.above[k] + np.cumsum(counts[k], axis=0) for k in range(3))
        s = self.sums
        s["won"] += (neg * (tp - pos / 2)).sum(axis=0)
        s["pairs_won"] += (latter * (before - former / 2)).sum(axis=0)
        for name, x in zip(("n_pos", "n_neg", "n_former", "n_latter"), counts, strict=True):
            s[name] += x.sum(axis=0)
        self.above = np.stack([tp[-1], fp[-1], before[-1]])
        # Precision counts where there are positives.
        some = np.flatnonzero(pos.any(axis=1))
        pos, neg, tp, fp = (x[some] for x in (pos, neg, tp, fp))
        with np.errstate(invalid="ignore", divide="ignore"):
            after = np.where(tp + fp > 0, tp / (tp + fp), 1.0)
            prior = np.where(tp - pos + fp - neg > 0, (tp - pos) / (tp - pos + fp - neg), 1.0)
        s["areas"] += (pos * (after + prior) / 2).sum(axis=0)
        s["steps"] += (pos * after).sum(axis=0)

    def rows(self) -> pa.RecordBatch:
        if self.open is not None:
            self._close(self.open[1][:, None])
        n = self.above.shape[1]
        columns = [pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, self.group[0], np.int32))]
        return pa.RecordBatch.from_arrays([*columns, *map(pa.array, self.sums.values())], names=["replicate", "year", *SUMS])


def _walk_ranges(draws: _Draws):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches come by year and range: the row of totals above it, then rows in falling order of scores."""
        walk = None
        for batch in batches:
            for group, rows in _groups(batch):
                if walk is None or walk.group != group:
                    if walk is not None:
                        yield walk.rows()
                    walk = _Walk(group, draws.width)
                head = rows.column("heads")
                if head[0].is_valid:
                    walk.start(head[0].as_py())
                    rows = rows.slice(1)
                score, role = rows.column("score").to_numpy(), rows.column("role").to_numpy()
                for low, drawn in draws.of(rows):
                    walk.add(score[low : low + len(drawn)], role[low : low + len(drawn)], drawn)
        if walk is not None:
            yield walk.rows()

    return run


def bootstrap_joint(
    df: DataFrame,
    key: str,
    scores: Sequence[str],
    time: str,
    event: str,
    n_replicates: int = 5000,
    seed: int = 42,
    censoring: DataFrame | None = None,
    ranges: int | None = None,
    tied: int = TIED,
) -> DataFrame:
    """``replicate``, ``year``, ``metric``, ``value``; the C-index has no year. What a replicate lacks is left out.

    Rows without a ``key``, which is unique, are neither drawn nor counted. The C-index takes its weights from
    ``censoring`` (time, g), by default the distribution of all cases. Results depend on the data and ``seed`` alone.
    """
    cases, n = numbered_cases(df, key, scores, time, event)
    attempts, total = draw_totals(cases, n, n_replicates, seed)
    draws = _Draws(n_replicates, replicate_keys(seed, attempts), thresholds(n))
    drawn = with_completing_draws(cases, total, n, seed).withColumn("counts", F.lit(None).cast("binary"))
    sums = _replicate_sums(_stored(drawn, "drawn-cases"), draws, scores, time, event, ranges or default_ranges(df), tied)
    if censoring is None:
        censoring = censoring_distribution(df, time, event)
    return _yearly_values(sums).unionByName(_c_index_values(sums, censoring))


def bootstrap_counted(
    df: DataFrame,
    key: str,
    scores: Sequence[str],
    time: str,
    event: str,
    n_replicates: int,
    seed: int = 42,
    with_c_index: bool = False,
    ranges: int | None = None,
    tied: int = TIED,
) -> DataFrame:
    """The same columns from the draws of ``draw_counts``: a case carries a byte per replicate through the walk."""
    cases, n = numbered_cases(df, key, scores, time, event)
    drawn = cases.join(draw_counts(cases, n, n_replicates, seed), "row_index")
    drawn = _stored(drawn.withColumn("extra", F.lit(None).cast("array<int>")), "drawn-cases")
    sums = _replicate_sums(drawn, _Draws(n_replicates), scores, time, event, ranges or default_ranges(df), tied)
    values = _yearly_values(sums)
    if with_c_index:
        values = values.unionByName(_c_index_values(sums, censoring_distribution(df, time, event)))
    return values


def numbered_cases(df: DataFrame, key: str, scores: Sequence[str], time: str, event: str) -> tuple[DataFrame, int]:
    """The cases with a key, numbered along it and stored, and how many they are."""
    needed = df.select(*dict.fromkeys([key, *scores, time, event]))
    numbered = with_row_index(needed, key)
    cases = _stored(numbered if key in (*scores, time, event) else numbered.drop(key), "cases")
    return cases, cases.agg(F.max("n_rows")).first()[0] or 0


def _replicate_sums(
    cases: DataFrame, draws: _Draws, scores: Sequence[str], time: str, event: str, ranges: int, tied: int
) -> DataFrame:
    """``replicate``, ``year`` and ``SUMS`` of cases with what gives their draws."""
    years = len(scores)
    units = _condense(_units(cases, scores, time, event), draws, tied)
    cells = units.groupBy("year", "score").agg(F.count("*").alias("n"))
    split = units.withColumn("_splits", range_splits(cells, "score", ["year"], ranges))
    placed = split.select(
        *UNIT, F.explode(F.array(range_of(F.col("score"), F.col("_splits"), ranges))).alias(RANGE_COLUMN)
    )
    # Every range of every year is a task's own; few bytes, but replicates times as many draws.
    home = (F.col("year") - 1) * ranges + F.col(RANGE_COLUMN)

    def in_order(rows: DataFrame, *first) -> DataFrame:
        return rows.repartitionById(years * ranges, home).sortWithinPartitions("year", RANGE_COLUMN, *first, F.col("score").desc(), "role")

    totals = in_order(placed).mapInArrow(_range_totals(draws), TOTALS)
    heads = totals.groupBy("year", "block").applyInArrow(_above, TOTALS).groupBy("year", RANGE_COLUMN)
    heads = heads.agg(F.collect_list(F.struct("block", "pos", "neg", "former")).alias("heads"))
    both = placed.unionByName(heads, allowMissingColumns=True)
    walked = in_order(both, F.col("heads").isNull()).mapInArrow(
        _walk_ranges(draws), "replicate int, year int, " + ", ".join(f"{s} double" for s in SUMS)
    )
    return _stored(walked.groupBy("replicate", "year").agg(*[F.sum(s).alias(s) for s in SUMS]), "replicate-sums")


def _yearly_values(sums: DataFrame) -> DataFrame:
    wide = sums.filter("n_pos > 0 AND n_neg > 0").select(
        "replicate",
        "year",
        (F.col("won") / (F.col("n_pos") * F.col("n_neg"))).alias("auroc"),
        (F.col("areas") / F.col("n_pos")).alias("auprc"),
        (F.col("steps") / F.col("n_pos")).alias("average_precision"),
    )
    return tidy_metrics(wide, ["replicate", "year"])


def _c_index_values(sums: DataFrame, censoring: DataFrame) -> DataFrame:
    weights = censoring.select((F.col("time").cast("int") + 1).alias("year"), "g")
    pairs = F.col("n_former") * F.col("n_latter")
    known = F.coalesce("g", F.when(pairs > 0, F.raise_error(F.lit("an event year has no censoring weight"))))
    w = F.when(known > 0, F.lit(1.0) / (known * known)).otherwise(0.0)
    index = sums.join(weights, "year", "left").groupBy("replicate")
    index = index.agg(F.sum(w * F.col("pairs_won")).alias("won"), F.sum(w * pairs).alias("pairs")).filter("pairs > 0")
    return index.select(
        "replicate",
        F.lit(None).cast("int").alias("year"),
        F.lit("c_index").alias("metric"),
        (F.col("won") / F.col("pairs")).alias("value"),
    )
