import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortscope.llm.decontamination import (
    common_subsequence,
    decontaminated,
    find_leaks,
    op3_decontamination,
    right_singular_vectors,
    words,
)

DOCS = "doc_id long, text string, leaks string, c0 int"
SF_DIR = "/root/testdata/sf0.001"


def prose(seed, n):
    r = random.Random(seed)
    return [f"{r.choice('bdfgklmnprst')}{r.choice('aeiou')}{r.randrange(400)}" for _ in range(n)]


def plain_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_common_subsequence():
    r = random.Random(1)
    for _ in range(300):
        a, b = ([r.randrange(5) for _ in range(r.randrange(1, 30))] for _ in range(2))
        mask = {}
        for i, w in enumerate(a):
            mask[w] = mask.get(w, 0) | 1 << i
        assert common_subsequence(mask, len(a), b) == plain_lcs(a, b)


def test_words():
    distinct, which, bounds = words(pa.array(["One, (two)  -- ONE", None, "", "é! É."]))
    names = distinct.to_pylist()
    assert [[names[w] for w in which[a:z]] for a, z in zip(bounds, bounds[1:], strict=False)] == [
        ["one", "two", "one"], [], [], ["é", "é"]
    ]


def test_singular_vectors(spark):
    rng = np.random.default_rng(3)
    dense = (rng.random((40, 5)) @ rng.random((5, 25))) * (rng.random((40, 25)) < 0.5)
    rows = [(np.flatnonzero(r).tolist(), r[r != 0].tolist()) for r in dense]
    found = right_singular_vectors(spark.createDataFrame(rows, "index array<int>, value array<double>"), 25, 6)
    exact = np.linalg.svd(dense)[2][:6]
    assert np.allclose(np.abs(np.sum(found.T * exact, axis=1)), 1, atol=1e-3)


@pytest.mark.parametrize("max_passages", [4096, 2])
def test_planted_leaks(spark, max_passages):
    items = {1: prose(1, 40), 2: prose(2, 12), 3: prose(3, 150), 4: prose(4, 5)}
    swapped = [w if i % 5 else "other" for i, w in enumerate(items[1])]
    texts = {
        10: prose(50, 300) + items[1] + prose(51, 300),
        11: prose(52, 77) + swapped + prose(53, 40),
        12: items[2],
        13: prose(54, 500) + items[3][70:] + prose(55, 9),
        14: prose(56, 30) + items[4] + prose(57, 30),
        15: prose(58, 2000),
        16: prose(59, 40) + items[1][:15] + prose(60, 40),
    }
    docs = spark.createDataFrame(
        [(d, " ".join(t).capitalize() + ".", "x", 1) for d, t in texts.items()] + [(None, None, None, None), (17, "", "x", 1)], DOCS
    )
    benchmark = spark.createDataFrame(
        [(i, " ".join(t)) for i, t in items.items()] * 2 + [(8, None), (None, ""), (9, "...")], "item_id long, text string"
    )
    found = find_leaks(docs, benchmark, max_passages=max_passages)
    assert found.columns == ["doc_id", "text", "c0", "leaks"] and found.count() == len(texts) + 2
    got = {r.doc_id: {leak.item_id for leak in r.leaks} for r in found.collect() if r.leaks}
    assert got == {10: {1}, 11: {1}, 12: {2}, 13: {3}, 14: {4}}
    kept = {r.doc_id for r in decontaminated(docs, benchmark).collect()}
    assert kept == {15, 16, 17, None}


def test_answers_must_be_there(spark):
    item = prose(1, 40)
    docs = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(item) + " the answer")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, " ".join(item), "The answer")], "item_id long, text string, answer string")
    got = {r.doc_id: len(r.leaks) for r in find_leaks(docs, benchmark).collect()}
    assert got == {1: 0, 2: 1}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c", None, 1)], DOCS)
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert find_leaks(docs, items.limit(0)).filter(F.size("leaks") > 0).count() == 0
    assert find_leaks(docs.limit(0), items).count() == 0


def test_whole_table_finds_every_exact_passage(spark):
    plain = lambda t: f" {' '.join(t.lower().split())} "
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()
    exact = {(d.doc_id, i.item_id) for d in docs for i in items if plain(i.text).strip() in plain(d.text)}
    got = {(r.doc_id, r.item_id) for r in op3_decontamination(spark, SF_DIR).collect()}
    assert exact and exact <= got
    assert {d for d, _ in got} == {d for d, _ in exact}


def zipf(rng, n):
    return [f"z{int(w)}" for w in 30_000 ** rng.random(n)]


def test_exact_copies_among_many_passages_and_in_many_documents(spark):
    """Every copy is found with a full block of passages, and of a passage that a third of the texts hold."""
    rng = np.random.default_rng(5)
    items = [zipf(rng, rng.integers(15, 60)) for _ in range(4096)]
    common = len(items) - 1
    planted = {d: common if d % 3 == 0 else d for d in range(300)}
    texts = [(d, " ".join(zipf(rng, 100) + items[p] + zipf(rng, 100))) for d, p in planted.items()]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    benchmark = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    got = {r.doc_id: {leak.item_id for leak in r.leaks} for r in find_leaks(docs, benchmark).collect()}
    assert [d for d, p in planted.items() if p not in got[d]] == []
