import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortscope.llm.periodic_runs import WaveletTree, find_runs, op11_periodic_runs, periodic_runs

BLANKS = re.compile(r"[\x20\x09-\x0D]+")


def words_of(text):
    return [w for w in BLANKS.split(text or "") if w]


def brute(words):
    """All runs of a list of words: every period, every maximal stretch, smallest period only."""
    found, n = {}, len(words)
    for q in range(1, n // 4 + 1):
        s = 0
        while s + q < n:
            e = s + q
            while e < n and words[e] == words[e - q]:
                e += 1
            if e - s >= max(6, 4 * q):
                found.setdefault((s, e), q)
            s = e - q + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapse(words, runs):
    gone = set()
    for s, n, q in runs:
        gone |= set(range(s + q, s + n))
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@given(st.lists(st.lists(st.integers(0, 2), max_size=60), min_size=1, max_size=6))
@settings(max_examples=300, deadline=None)
def test_runs_of_few_letters(texts):
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    got = find_runs(np.array(sum(texts, []), np.int64), bounds)
    expected = [(i, *r) for i, t in enumerate(texts) for r in brute(t)]
    assert [tuple(x) for x in got.T.tolist()] == expected


@given(st.integers(0, 10**6))
@settings(max_examples=150, deadline=None)
def test_runs_with_inner_repetition(seed):
    """Periods whose own words repeat, cut off anywhere and side by side."""
    r = random.Random(seed)
    words = []
    for _ in range(r.randrange(1, 5)):
        inner = [r.randrange(3) for _ in range(r.randrange(1, 5))]
        period = inner * r.randrange(1, 6) + [r.randrange(3) for _ in range(r.randrange(3))]
        words += (period * 7)[: r.randrange(1, 7 * len(period) + 1)] + [r.randrange(4) for _ in range(r.randrange(4))]
    got = find_runs(np.array(words, np.int64), np.array([0, len(words)]))
    assert [tuple(x[1:]) for x in got.T.tolist()] == brute(words)


def test_wavelet_tree():
    r = np.random.default_rng(0)
    values = r.permutation(100)
    tree = WaveletTree(values, 7)
    left = r.integers(0, 100, 300)
    right = np.array([r.integers(x, 101) for x in left])
    bound = r.integers(0, 101, 300)
    below = tree.below(left, right, bound)
    for a, b, x, n in zip(left, right, bound, below, strict=True):
        assert n == (values[a:b] < x).sum()
    full = right > left
    k = np.array([r.integers(0, b - a) for a, b in zip(left[full], right[full], strict=True)])
    for a, b, i, v in zip(left[full], right[full], k, tree.smallest(left[full], right[full], k), strict=True):
        assert v == sorted(values[a:b])[i]


def test_odd_rows_and_clashing_columns(spark):
    texts = [
        None, "", " \t\n", "a", "a a a a a", "a a a a a a", " a  a\ta\na a a\x0b", "a a a a a a", "x y x y x y x y z",
        "x y x y x y x y z", "  ".join(["é", "b", "c"] * 5), "a a a a a a b a a a a a a b a a a a a a b a a a a a a b",
        "w " * 30_000, " ".join(f"w{i % 5000}" for i in range(40_000)), " ".join(f"u{i}" for i in range(30_000)),
    ]
    rows = [(i if i % 3 else None, t, "r", 1, 2.0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, collapsed string, c0 int, runs double")
    got = periodic_runs(docs)
    assert got.columns == ["doc_id", "text", "c0", "runs", "collapsed"]
    found = {r.text: r for r in got.collect()}
    assert len(found) == len(set(texts)) and got.count() == len(texts)
    for text in texts:
        words = words_of(text)
        runs = brute(words) if len(words) < 1000 else None
        if runs is not None:
            assert [tuple(r) for r in found[text].runs] == runs, text
            assert found[text].collapsed == collapse(words, runs)
    assert [tuple(r) for r in found[texts[-3]].runs] == [(0, 30_000, 1)]
    assert [tuple(r) for r in found[texts[-2]].runs] == [(0, 40_000, 5000)]
    assert found[texts[-2]].collapsed == " ".join(f"w{i}" for i in range(5000))
    assert found[texts[-1]].runs == []


def test_empty_table(spark):
    assert periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("sf", ["0.001"])
def test_whole_table_against_brute_force(spark, sf):
    got = {r.doc_id: r for r in op11_periodic_runs(spark, f"/root/testdata/sf{sf}").collect()}
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc_id, text in docs:
        words = words_of(text)
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        runs = brute(words)
        r = got[doc_id]
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapse(words, runs).encode()).hexdigest()
    assert any(r.n_runs for r in got.values())
