import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortscope.llm.spelling_variants import (
    close_pairs,
    fit_tree,
    letter_counts,
    op13_spelling_variants,
    reached,
    spelling_variants,
    word_counts,
)

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")


def edits(word):
    """Every word with one letter of ``word`` left out, with its place."""
    return {(i, word[:i] + word[i + 1 :]) for i in range(len(word))}


def brute(counts, ratio=5):
    """word: (form, root, n, n_near, form_n), by looking left-out letters up."""
    near = {w: set() for w in counts}
    holes = {}
    for w in counts:
        for i, rest in edits(w):
            holes.setdefault((i, rest), []).append(w)
            if rest in counts:
                near[w].add(rest)
                near[rest].add(w)
    for words in holes.values():
        for w in words:
            near[w] |= {v for v in words if v != w}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), counts.get(form[w]))
    return out


def as_told(df):
    rows = df.collect()
    told = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(told) == len(rows)
    return told


@given(st.lists(st.text("abc", min_size=5, max_size=5), min_size=1, max_size=120, unique=True), st.integers(0, 2))
@settings(max_examples=60, deadline=None)
def test_tree_finds_all_close_vectors(words, radius):
    vectors = letter_counts(words)
    d, a = close_pairs(vectors, vectors, radius)
    distance = np.abs(vectors[:, None] - vectors[None]).sum(axis=2)
    assert sorted(zip(d, a, strict=True)) == [tuple(x) for x in np.argwhere(distance <= radius)]
    tree, boxes = fit_tree(vectors[::2], 8)
    own, home = reached(tree, vectors, 0)
    assert sorted(own) == list(range(len(words))) and home.max() < boxes
    home = dict(zip(own, home, strict=True))
    seen = set(zip(*reached(tree, vectors, radius), strict=True))
    for i, j in np.argwhere(distance <= radius):
        assert (i, home[j]) in seen


@pytest.mark.parametrize("box_rows", [4, 8192])
def test_words_against_brute_force(spark, box_rows):
    r = random.Random(1)
    words = {"".join(r.choice("abÀÿé") for _ in range(r.randrange(4, 9))) for _ in range(600)}
    words |= {"", "a", "ab", "b", "ba", "x" * 3000, "x" * 3001, "x" * 2999 + "y", "\U0001f600ab", "\U0001f600b"}
    counts = {w: r.choice([1, 2, 3, 5, 10, 25, 50, 250]) for w in words}
    got = spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n int"), box_rows=box_rows)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert as_told(got) == brute(counts)


def test_long_chain_of_forms(spark):
    words = ["a" * i + "b" * (30 - i) for i in range(12)]
    counts = {w: 5 ** (i + 1) for i, w in enumerate(words)}
    told = as_told(spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert told == brute(counts)
    assert told[words[0]][1] == words[-1]


def test_odd_documents(spark):
    rows = [(None, "Lettera lettera"), (1, None), (2, ""), (3, "12 -- 3"), (4, "lettera LETTERA letterb " * 4), (4, "lettera LETTERA letterb " * 4)]
    docs = spark.createDataFrame([(d, t, "w", 1) for d, t in rows], "doc_id long, text string, word string, n int")
    counts = {r.word: r.n for r in word_counts(docs, min_count=1).collect()}
    assert counts == plain_counts(rows, 1)
    assert word_counts(docs.limit(0)).count() == 0
    assert spelling_variants(word_counts(docs.limit(0))).count() == 0


def plain_counts(rows, least):
    small = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts = Counter()
    for doc_id, text in rows:
        for run in LETTERS.findall(text or ""):
            run = run.translate(small)
            h = zlib.crc32(f"{doc_id}:{run}".encode()) if doc_id is not None else 1
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= least}


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_whole_table_against_brute_force(spark, sf):
    path = f"/root/testdata/sf{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    told = as_told(op13_spelling_variants(spark, path))
    assert told == brute(plain_counts(rows, 5))
    assert any(r[3] for r in told.values())
