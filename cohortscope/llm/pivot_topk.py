"""Exact top-k by inner product with a pivot-distance index.

The index keys every vector by its nearest pivot and its distance to it. Distances to a pivot are cut into
rings (annuli), and a cell, one ring around one pivot, is known by the number of its vectors, its inner and
outer distance and its largest norm. For a query at distance ``g`` from the nearest edge of that ring,
the triangle inequality gives ``|q - x| >= g``, so no vector in the cell scores above
``(|q|^2 + max|x|^2 - g^2) / 2``. A query expands its cells in the order of that bound: first the best ones,
which give it a k-th score, then those whose bound still reaches that score. The cells that remain can't
hold a better vector, nor an equal one that wins the tie. The same bound skips single blocks in a cell.

There are a quarter of the square root of the number of vectors as pivots, ``MIN_PIVOTS`` at least and
``MAX_PIVOTS`` at most, so cells stay small as a table grows. They come from a sample of ``SAMPLE`` vectors a
pivot by the smallest hashes of their ids, spread out greedily. They decide what is skipped, never what is
found, so the answer is exact for any pivots. How much is skipped depends on the vectors: where they lie in
clusters most cells are, where all are about as far from each other none can be, and the search is a
blocked product of all queries with all vectors.

Each cell is dealt into blocks of about ``BLOCK`` vectors, so a hot cell is many rows. Of equal vectors only
the ``k + 1`` with the smallest ids can matter to any query, and the rest is cut before the shuffle; a query's
own row is then still left out. Queries travel in packs to the cells they visit, and tasks multiply blocks with
packs.

Defined results: a vector that is null or holds a null or non-finite component takes no part, nor does a row
without an id; rows that share an id are rows of their own, each a candidate of the others and, if the id is
asked, a query with ranks of its own; a shorter vector continues with zeros;
ties go to smaller ids; a query with fewer candidates than k gets them all; no queries or no candidates, or an
empty table, give no rows; other columns are not read. Components are whole numbers, and a sum of
squares of 2**52 and more raises an error, since scores must be exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortscope.llm.base import query, table, written

MIN_PIVOTS = 32
MAX_PIVOTS = 2048
RINGS = 8
SAMPLE = 16
BLOCK = 2048
PACK = 256
FIRST_CELLS = 4
BOUNDS = 4_000_000
EXACT = 2.0**52
BLOCKS_SCHEMA = "cell int, near double, far double, norm double, ids binary, numbers binary, vectors binary"
PACKS_SCHEMA = "cell int, numbers binary, vectors binary, least binary"
FOUND_SCHEMA = "query long, vec_id long, score long"


@dataclass
class Index:
    """What every task knows: the pivots and the cells' edges, at most MAX_PIVOTS * RINGS rows."""

    pivots: np.ndarray
    near: np.ndarray
    far: np.ndarray
    norm: np.ndarray
    count: np.ndarray

    def distances(self, x: np.ndarray) -> np.ndarray:
        """From each row to each pivot; squares are whole numbers and exact."""
        squares = (x**2).sum(axis=1)[:, None] + (self.pivots**2).sum(axis=1) - 2 * (x @ self.pivots.T)
        return np.sqrt(np.maximum(squares, 0.0))

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """The largest score that each cell could have for each row; cells without vectors have none."""
        d = np.repeat(self.distances(x), RINGS, axis=1)
        return np.where(self.count > 0, score_bound((x**2).sum(axis=1)[:, None], d, self.near, self.far, self.norm), -np.inf)

    def visited(self, x: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The share of all vectors in the cells that a search for each row must look into if its k-th score is known."""
        return (self.bounds(x) >= least[:, None]) @ self.count / self.count.sum()


def score_bound(square: np.ndarray, distance: np.ndarray, near, far, norm) -> np.ndarray:
    """No vector between ``near`` and ``far`` of a pivot scores above it; rounding is allowed for."""
    gap = np.maximum(0.0, np.maximum(near - distance, distance - far))
    gap = np.maximum(0.0, gap - 1e-9 * (distance + far))
    bound = (square + norm - gap**2) / 2
    return bound + 1e-9 * np.abs(square + norm) + 1e-6


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of a matrix, short ones filled up with zeros."""
    offsets = vectors.offsets.to_numpy()
    values = vectors.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    if (sizes == width).all():
        return values[offsets[0] : offsets[-1]].reshape(len(sizes), width).astype(np.float64)
    out = np.zeros((len(sizes), width))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(rows)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = values[offsets[0] : offsets[-1]]
    return out


def _spread(sample: np.ndarray, n: int) -> np.ndarray:
    """Greedily, the vector farthest from those already chosen."""
    chosen = [0]
    gap = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(sample)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def _placed(pivots: np.ndarray):
    width = pivots.shape[1]
    index = Index(pivots, *[np.zeros(0)] * 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vector"), width)
            d = index.distances(x)
            nearest = d.argmin(axis=1)
            rows = np.ascontiguousarray(x, "<f8")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("number"),
                    batch.column("vec_id"),
                    pa.array(nearest.astype(np.int32)),
                    pa.array(d[np.arange(len(x)), nearest]),
                    pa.array((x**2).sum(axis=1)),
                    pa.array([r.tobytes() for r in rows], pa.binary()),
                ],
                names=["number", "vec_id", "pivot", "distance", "norm", "vector"],
            )

    return run


def _as_block(key: tuple, group: pa.Table) -> pa.Table:
    group = group.combine_chunks().sort_by([("distance", "ascending"), ("number", "ascending")])
    d, norm = group.column("distance").to_numpy(), group.column("norm").to_numpy()
    ids, numbers = (group.column(c).to_numpy().astype("<i8").tobytes() for c in ("vec_id", "number"))
    return pa.table(
        {
            "cell": pa.array([key[0].as_py()], pa.int32()),
            "near": [float(d[0])],
            "far": [float(d[-1])],
            "norm": [float(norm.max())],
            "ids": pa.array([ids], pa.binary()),
            "numbers": pa.array([numbers], pa.binary()),
            "vectors": pa.array([b"".join(group.column("vector").to_pylist())], pa.binary()),
        }
    )


def n_pivots(n: int) -> int:
    return min(MAX_PIVOTS, max(MIN_PIVOTS, math.isqrt(n) // 4))


def build_index(vectors: DataFrame, k: int) -> tuple[Index, DataFrame] | None:
    """The index of ``vectors`` (number, vec_id, vector), every one of them, and its blocks."""
    spark = vectors.sparkSession
    equal = Window.partitionBy(F.xxhash64("vector"), "vector").orderBy("vec_id", "number")
    kept = written(vectors.withColumn("n", F.row_number().over(equal)).filter(F.col("n") <= k + 1).drop("n"), "vectors")
    square = F.aggregate("vector", F.lit(0.0), lambda a, v: a + v * v)
    width, largest, n = kept.agg(F.max(F.size("vector")), F.max(square), F.count("*")).first()
    if width is None:
        return None
    if largest >= EXACT:
        raise ValueError("components too large for exact scores")
    wanted = n_pivots(n)
    few = kept.select("vec_id", "vector").orderBy(F.xxhash64("vec_id"), "vec_id", "number").limit(SAMPLE * wanted)
    pivots = _spread(_matrix(few.select("vector").toArrow().column("vector").combine_chunks(), width), wanted)
    placed = written(
        kept.mapInArrow(_placed(pivots), "number long, vec_id long, pivot int, distance double, norm double, vector binary"),
        "placed",
    )
    inner = [i / RINGS for i in range(1, RINGS)]
    # One row a pivot, and below one row a cell: the joins broadcast at most MAX_PIVOTS * RINGS short rows.
    edges = placed.groupBy("pivot").agg(F.percentile_approx("distance", inner, 1000).alias("edges"))
    edges = spark.createDataFrame(edges.collect(), "pivot int, edges array<double>")
    ring = F.size(F.filter("edges", lambda e: e < F.col("distance")))
    celled = placed.join(F.broadcast(edges), "pivot").withColumn("cell", F.col("pivot") * RINGS + ring).drop("edges")
    cells = len(pivots) * RINGS
    near, far, norm, count = (np.zeros(cells) for _ in range(4))
    for r in celled.groupBy("cell").agg(F.min("distance"), F.max("distance"), F.max("norm"), F.count("*")).collect():
        near[r[0]], far[r[0]], norm[r[0]], count[r[0]] = r[1:]
    dealt = [(cell, -(-int(c) // BLOCK)) for cell, c in enumerate(count.tolist()) if c]
    blocks = (
        celled.join(F.broadcast(spark.createDataFrame(dealt, "cell int, deals int")), "cell")
        .withColumn("deal", F.pmod(F.xxhash64("number"), "deals"))
        .groupBy("cell", "deal")
        .applyInArrow(_as_block, BLOCKS_SCHEMA)
    )
    return Index(pivots, near, far, norm, count), written(blocks, "blocks")


def _visits(index: Index, first: bool):
    """Queries in packs under each cell they go to: the best cells, or the others that may still matter."""
    width = index.pivots.shape[1]
    step = max(1, BOUNDS // len(index.count))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                x = _matrix(part.column("vector"), width)
                numbers = part.column("number").to_numpy().astype("<i8")
                least = part.column("least").to_numpy(zero_copy_only=False).astype("<f8")
                bound = index.bounds(x)
                order = np.argsort(-bound, axis=1, kind="stable")
                best = np.zeros(bound.shape, bool)
                np.put_along_axis(best, order[:, :FIRST_CELLS], True, axis=1)
                wanted = (best if first else ~best) & (bound >= least[:, None]) & (bound > -np.inf)
                out = [[], [], [], []]
                for cell in np.flatnonzero(wanted.any(axis=0)).tolist():
                    own = np.flatnonzero(wanted[:, cell])
                    for a in range(0, len(own), PACK):
                        rows = own[a : a + PACK]
                        for column, value in zip(
                            out, (cell, numbers[rows].tobytes(), x[rows].tobytes(), least[rows].tobytes()), strict=True
                        ):
                            column.append(value)
                kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["cell", "numbers", "vectors", "least"]
                )

    return run


def _scored(index: Index, k: int):
    """The k best of each block for each query of a pack."""
    width = index.pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[np.zeros(0, np.int64)] for _ in range(3)]
            for row in range(batch.num_rows):
                cell, near, far, norm, ids, numbers, vectors, q_numbers, q_vectors, least = (
                    batch.column(c)[row].as_py() for c in range(batch.num_columns)
                )
                q = np.frombuffer(q_vectors).reshape(-1, width)
                asked, least = np.frombuffer(q_numbers, "<i8"), np.frombuffer(least)
                distance = np.sqrt(((q - index.pivots[cell // RINGS]) ** 2).sum(axis=1))
                may = score_bound((q**2).sum(axis=1), distance, near, far, norm) >= least
                q, asked = q[may], asked[may]
                x, ids = np.frombuffer(vectors).reshape(-1, width), np.frombuffer(ids, "<i8")
                score = q @ x.T
                score[asked[:, None] == np.frombuffer(numbers, "<i8")] = -np.inf
                n = min(k, len(ids))
                # Everything from the k-th score up, so that ties are settled by id and not by place.
                edge = np.partition(score, len(ids) - n, axis=1)[:, len(ids) - n] if len(q) else np.zeros(0)
                at, column = np.nonzero((score >= edge[:, None]) & (score > -np.inf) & (score >= least[may][:, None]))
                value = score[at, column].astype(np.int64)
                order = np.lexsort((ids[column], -value, at))
                at, column, value = at[order], column[order], value[order]
                rank = np.arange(len(at)) - np.searchsorted(at, at)
                kept = rank < k
                for c, v in zip(found, (asked[at[kept]], ids[column[kept]], value[kept]), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c)) for c in found], names=["query", "vec_id", "score"]
            )

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def numbered(vectors: DataFrame, k: int) -> DataFrame:
    """number, vec_id, vector, copy and n: usable rows, of ``n`` equal ones the first ``k + 1``.

    The stored numbers tell rows apart and nothing else.
    """
    usable = F.col("vector").isNotNull() & F.col("vec_id").isNotNull() & F.forall("vector", lambda v: v.isNotNull())
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector"))
    counted = rows.filter(usable).groupBy("vec_id", "vector").agg(F.count("*").alias("n"))
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k + 1)))))
    return written(copies.withColumn("number", F.monotonically_increasing_id()), "usable-vectors")


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` largest inner products of each query.

    ``vectors`` has vec_id and vector, whole numbers as doubles; the rows where ``is_query``, a condition on
    vec_id, holds are the queries, and all rows but a query's own are its candidates.
    """
    rows = numbered(vectors, k)
    built = build_index(rows.select("number", "vec_id", "vector"), k)
    if built is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    index, blocks = built
    queries = rows.filter(is_query & (F.col("copy") == 1)).select("number", "vector")

    def search(asked: DataFrame, first: bool) -> DataFrame:
        packs = asked.select("number", "vector", "least").mapInArrow(_visits(index, first), PACKS_SCHEMA)
        packs = packs.select("cell", F.col("numbers").alias("q_numbers"), F.col("vectors").alias("q_vectors"), "least")
        met = blocks.join(packs, "cell").select(*blocks.columns, "q_numbers", "q_vectors", "least")
        return met.mapInArrow(_scored(index, k), FOUND_SCHEMA)

    nothing = F.lit(float("-inf"))
    near = written(_best(search(queries.withColumn("least", nothing), True), k), "best-of-first-cells")
    kth = near.filter(F.col("rank") == k).select(F.col("query").alias("number"), F.col("score").cast("double").alias("least"))
    rest = queries.join(kth, "number", "left").withColumn("least", F.coalesce("least", nothing))
    found = _best(near.select("query", "vec_id", "score").union(search(rest, False)), k)
    # Equal rows ask the same and get the same.
    asked = rows.filter(is_query & (F.col("copy") == 1)).select(
        F.col("number").alias("query"), F.col("vec_id").alias("query_id"), F.sequence(F.lit(1), "n").alias("copies")
    )
    answers = found.join(asked, "query").withColumn("copies", F.explode("copies"))
    return answers.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS number, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vector
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.number, q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_inner_product(q.vector, c.vector) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.number <> q.number
)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY number ORDER BY score DESC, vec_id) AS n FROM scored
) WHERE n <= 5
"""


@query("op2_pivot_topk", ORACLE)
def op2_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest inner products of every 50th vector with all others."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    vectors = (
        table(spark, sf_dir, "embeddings")
        .filter(x.isNotNull() & finite)
        .select("vec_id", F.transform(x, lambda v: F.floor(v.cast("double") * 256).cast("double")).alias("vector"))
    )
    return exact_top_k(vectors, F.col("vec_id") % 50 == 0)
