import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortscope.llm import suffix_dedup
from cohortscope.llm.suffix_dedup import Strings, exact_order, find_anchors, op12_suffix_dedup, remove_repeated_strings


def brute(rows, length=100):
    """Spans and rest of each text; rows (doc_id, text) come in order, all different."""
    first, out = set(), []
    for _, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for p in range(len(raw) - length + 1):
            string = raw[p : p + length]
            if string in first:
                gone[p : p + length] = True
            first.add(string)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], gone]).astype(int)))
        spans = [tuple(x) for x in edge.reshape(-1, 2).tolist()]
        out.append((spans, bytes(b for b, g in zip(raw, gone, strict=False) if not g)))
    return out


def got(df):
    return {(r.doc_id, r.text): ([tuple(s) for s in r.spans], bytes(r.kept) if r.kept is not None else b"") for r in df.collect()}


def prose(r, n):
    return "".join(r.choice("abcdé ") for _ in range(n))


def planted(seed, n=60):
    """Texts with passages around the length, shared at both ends, inside one another and with themselves."""
    r = random.Random(seed)
    shared = [prose(r, k) for k in (20, 40, 45, 60, 98, 99, 100, 101, 150, 400)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(r.randrange(1, 6)):
            passage = r.choice(shared)
            if r.random() < 0.3:
                a = r.randrange(len(passage))
                passage = passage[a : a + r.randrange(1, len(passage))]
            parts += [prose(r, r.randrange(60)), passage]
        texts.append("".join(parts))
    return texts + ["a" * 350, "ab" * 120, "a" * 99, "a" * 100, "", "ab" * 300 + shared[-1] * 3]


@given(st.lists(st.binary(max_size=12), min_size=1, max_size=40), st.integers(0, 10**6))
@settings(max_examples=150, deadline=None)
def test_order_and_common_extensions(strings, seed):
    r = random.Random(seed)
    strings = [bytes(b % 3 for b in s) for s in strings]
    group = np.sort([r.randrange(4) for _ in strings])
    sizes = np.array([len(s) for s in strings])
    stops = np.cumsum(sizes)
    begins = np.searchsorted(group, group)
    ends = np.searchsorted(group, group, side="right")
    data = np.frombuffer(b"".join(strings) or b"x", np.uint8)
    order, shared = exact_order(data, stops - sizes, sizes, begins, ends)
    found = [(group[i], strings[i]) for i in order]
    assert found == sorted(found) and sorted(order) == list(range(len(strings)))
    for (g, a), (h, b), n in zip(found, found[1:], shared[1:], strict=False):
        common = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert n == (common if g == h else -1)


def test_wrong_hashes_are_noticed(monkeypatch):
    """With a base of one, hashes are sums, so that strings of the same bytes collide."""
    strings = [b"abc", b"acb", b"bac", b"bca", b"cab", b"cba"] * 2
    sizes = np.full(len(strings), 3)
    data = np.frombuffer(b"".join(strings), np.uint8)
    begin, end = np.zeros(len(strings), int), np.full(len(strings), len(strings))
    starts = np.cumsum(sizes) - sizes
    wrong = Strings(data, starts, sizes, 1).common(np.array([0]), np.array([2]))
    assert wrong[0] == 3
    for bases in ((1, suffix_dedup.BASES[0]), (1, 1)):
        monkeypatch.setattr(suffix_dedup, "BASES", bases)
        order, shared = exact_order(data, starts, sizes, begin, end)
        assert [strings[i] for i in order] == sorted(strings)
        assert shared.tolist() == [-1, 3, 1, 3, 0, 3, 1, 3, 0, 3, 1, 3]


@given(st.text("ab", min_size=0, max_size=300), st.integers(0, 30))
@settings(max_examples=100, deadline=None)
def test_equal_strings_have_equal_anchors(text, cut):
    raw = np.frombuffer((text + "|" + text[cut:]).encode(), np.uint8)
    ends = np.where(np.arange(len(raw)) < len(text) + 1, len(text) + 1, len(raw))
    key, _, at, m, left = find_anchors(raw, ends, 20, 6)
    seen = {}
    for k, a, n, o in zip(key, at, m, left, strict=True):
        for j in range(n):
            assert 0 <= o - j <= 14
            string = raw[a + j : a + j + 20].tobytes()
            assert len(string) == 20 and seen.setdefault(string, (k, o - j)) == (k, o - j)
    assert sum(m) == max(0, len(text) + 1 - 19) + max(0, len(raw) - len(text) - 1 - 19)


@pytest.mark.parametrize("seed, max_group", [(0, 10_000), (1, 2)])
def test_planted_passages_against_brute_force(spark, seed, max_group):
    """Small bounds have groups divided down to single strings."""
    rows = list(enumerate(dict.fromkeys(planted(seed))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = got(remove_repeated_strings(docs, max_group=max_group))
    assert len(found) == len(rows)
    assert [found[r] for r in rows] == brute(rows)


def test_pieces_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 257)
    r = random.Random(5)
    passage = prose(r, 700)
    rows = [(1, prose(r, 900) + passage), (2, passage + prose(r, 300) + passage[100:500]), (3, prose(r, 100) + passage[:350])]
    batch = suffix_dedup.pa.RecordBatch.from_pydict({"id": [1, 2, 3], "t": [0, 0, 0], "text": [t for _, t in rows]})
    pieces = list(suffix_dedup._anchors(100, 32)([batch]))
    strings = sum(sum(b.column("m").to_pylist()) for b in pieces)
    assert strings == sum(len(t.encode()) - 99 for _, t in rows)
    long = [(i, (prose(random.Random(i), 2000) + passage) * 400) for i in range(3)]
    docs = spark.createDataFrame(long, "doc_id long, text string")
    found = got(remove_repeated_strings(docs))
    for i, text in long:
        spans, kept = found[(i, text)]
        raw = text.encode()
        own = len(raw) // 400
        assert kept == (raw[:own] if i == 0 else raw[: own - len(passage.encode())])[: len(kept)]
        assert abs(len(kept) - (own if i == 0 else own - len(passage.encode()))) < 100 and len(spans) == 1


def test_odd_rows_and_clashing_columns(spark):
    r = random.Random(9)
    a, b = prose(r, 300), prose(r, 250)
    rows = [(7, a), (3, None), (4, ""), (None, a), (2, a), (2, a), (2, b), (None, b), (None, a + b), (8, "short")]
    docs = spark.createDataFrame([(d, t, "k", 1, "s") for d, t in rows], "doc_id long, text string, kept string, id int, spans string")
    out = remove_repeated_strings(docs)
    assert out.columns == ["doc_id", "text", "id", "spans", "kept"]
    found = {(x.doc_id, x.text): ([tuple(v) for v in x.spans], bytes(x.kept) if x.kept is not None else None) for x in out.collect()}
    assert out.count() == len(rows) and len(found) == len(set(rows))
    hashes = {x.text: x.h for x in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(set(rows), key=lambda x: (x[0] is None, x[0] or 0, hashes[x[1]]))
    for row, (spans, kept) in zip(order, brute(order), strict=True):
        assert found[row] == (spans, None if row[1] is None else kept), row


def test_empty_table(spark):
    assert remove_repeated_strings(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_whole_table_against_brute_force(spark, sf):
    path = f"/root/testdata/sf{sf}"
    rows = sorted(tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect())
    expected = {}
    for (doc_id, text), (spans, kept) in zip(rows, brute(rows), strict=True):
        gone = sum(z - a for a, z in spans)
        expected[doc_id] = (len(text.encode()), gone, len(spans), hashlib.sha256(kept).hexdigest())
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op12_suffix_dedup(spark, path).collect()}
    assert found == expected and any(x[1] for x in found.values())
