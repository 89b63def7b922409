import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortscope.llm import pivot_topk
from cohortscope.llm.pivot_topk import exact_top_k, op2_pivot_topk
from workload.check import compare, connect

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, vector array<double>, score string, cell int"


def brute(rows, is_query, k):
    usable = [(i, v) for i, v in rows if i is not None and v is not None and all(c is not None for c in v)]
    out = []
    for a, (q, x) in enumerate(usable):
        if is_query(q):
            others = [(i, y) for b, (i, y) in enumerate(usable) if b != a]
            scores = [(-int(sum(c * d for c, d in zip(x, y, strict=False))), i) for i, y in others]
            out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def run(spark, rows, k=5):
    df = spark.createDataFrame([(i, v, "s", 1) for i, v in rows], SCHEMA)
    return sorted(map(tuple, exact_top_k(df, F.col("vec_id") % 3 == 0, k).collect()))


@pytest.mark.parametrize("block", [2048, 7])
def test_clustered_vectors_copies_and_ties(spark, monkeypatch, block):
    monkeypatch.setattr(pivot_topk, "BLOCK", block)
    rng = np.random.default_rng(2)
    centres = rng.integers(-60, 60, (6, 8))
    rows = [(i, (centres[i % 6] + rng.integers(-3, 4, 8)).astype(float).tolist()) for i in range(240)]
    rows += [(1000 + i, rows[5][1]) for i in range(150)] + [(2000 + i, [0.0] * 8) for i in range(40)]
    assert run(spark, rows) == brute(rows, lambda q: q % 3 == 0, 5)


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 2.0]), (3, [2.0]), (6, []), (9, None), (12, [1.0, None]), (None, [5.0, 5.0]), (1, [1.0, -2.0]),
        (1, [1.0, -2.0]), (2, [3.0, 3.0]), (2, [4.0, 4.0]), (15, [-1.0, 0.0, 7.0]),
        (3, [9.0, 9.0]), (18, [1.0, 1.0]), *[(21, [2.0, 2.0])] * 9, (24, [0.0, 0.0, 1.0]), (24, [0.0, 0.0, 1.0]),
    ]
    assert run(spark, rows) == brute(rows, lambda q: q % 3 == 0, 5)
    assert run(spark, rows, 50) == brute(rows, lambda q: q % 3 == 0, 50)


def test_empty_single_and_too_large(spark):
    assert run(spark, []) == [] and run(spark, [(3, [1.0])]) == [] and run(spark, [(1, [1.0]), (2, [1.0])]) == []
    with pytest.raises(ValueError):
        run(spark, [(3, [1e12]), (4, [1.0])])


def test_cells_are_skipped_where_vectors_lie_in_clusters(spark):
    rng = np.random.default_rng(3)
    centres = rng.integers(-4000, 4000, (40, 8))
    x = (centres[np.arange(4000) % 40] + rng.integers(-20, 21, (4000, 8))).astype(float)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, vector array<double>")
    index, blocks = pivot_topk.build_index(pivot_topk.numbered(df, 5), 5)
    assert index.count.sum() == 4000 and blocks.count() >= (index.count > 0).sum() >= 40
    queries = x[::50]
    least = np.sort(queries @ x.T, axis=1)[:, -6]
    share = index.visited(queries, least)
    assert np.median(share) < 0.1, np.median(share)
    got = exact_top_k(df, F.col("vec_id") % 50 == 0).collect()
    assert sorted(map(tuple, got)) == brute(list(enumerate(x.tolist())), lambda q: q % 50 == 0, 5)


def test_pivots_grow_with_the_rows_up_to_a_bound():
    assert [pivot_topk.n_pivots(n) for n in (0, 100, 10**6, 10**12)] == [32, 32, 250, 2048]


def test_whole_table_against_sql(spark):
    assert compare(op2_pivot_topk(spark, SF_DIR), connect(SF_DIR), pivot_topk.ORACLE) == ""
