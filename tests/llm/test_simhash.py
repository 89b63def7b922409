import itertools

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cohortscope.llm.components import connected_components
from cohortscope.llm.simhash import fingerprint, fingerprint_links, near_duplicates

SCHEMA = "doc_id long, text string, fp string, component string"


def brute_fingerprint(text):
    words = []
    for w in (text or "").translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" "):
        if w:
            words.append("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w))
    if not words:
        return 0
    spans = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in spans]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    label = {p: p for p in prints}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in itertools.combinations(sorted(label), 2):
        if bin(a ^ b).count("1") <= 3:
            label[root(b)] = root(a)
    return {p: root(p) for p in label}


@pytest.mark.parametrize(
    "text", [None, "", " \n\t", "One", "one TWO", "Éa b c\x0bd É", "a b c d e f g a b c d", "x\x1cy z"]
)
def test_fingerprint(text):
    assert fingerprint(text) == brute_fingerprint(text)


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, j) for j in range(1000, 1200)] + [(5, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 100 for i in range(100, 161)} | {7: 7} | {j: 7 for j in range(1000, 1200)}
    assert got == want


@pytest.mark.parametrize("max_list", [512, 6, 1])
def test_links_find_every_component(spark, max_list):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    prints = set(base.tolist())
    for b in base.tolist():
        for _ in range(25):
            p = b
            for bit in rng.integers(0, 64, rng.integers(1, 6)).tolist():
                p ^= 1 << bit
            prints.add(p)
    signed = {p - (1 << 64) if p >> 63 else p: p for p in prints}
    nodes = spark.createDataFrame([(s,) for s in signed], "fp long")
    links = fingerprint_links(nodes, 3, max_list)
    assert all(bin(signed[a] ^ signed[b]).count("1") <= 3 for a, b in links.collect())
    got = {}
    for r in connected_components(links).collect():
        got.setdefault(r.component, set()).add(signed[r.node])
    want = {}
    for p, r in brute_components(prints).items():
        want.setdefault(r, set()).add(p)
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_documents_with_nulls_copies_and_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(400))
    rows = [
        (5, None, "x", "y"), (3, "", None, None), (9, long, None, None), (2, long.upper(), None, None),
        (2, long.upper(), None, None), (None, long, None, None), (7, long + " tail", None, None), (4, "alone here", None, None),
    ]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    prints = {brute_fingerprint(t) for _, t, _, _ in rows}
    roots = brute_components(prints)
    for doc_id, text, _, _ in rows:
        same = [d for d, t, _, _ in rows if d is not None and roots[brute_fingerprint(t)] == roots[brute_fingerprint(text)]]
        assert any(r.doc_id == doc_id and r.component_id == min(same) for r in got)
    assert {r.component_id for r in got if r.fp == 0} == {3}


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    prints = {d: brute_fingerprint(t) for d, t in texts.items()}
    roots = brute_components(set(prints.values()))
    first = {}
    for d in sorted(prints, reverse=True):
        first[roots[prints[d]]] = d
    got = near_duplicates(docs).select("doc_id", F.hex("fp").alias("h"), "component_id").collect()
    assert {(r.doc_id, int(r.h, 16), r.component_id) for r in got} == {
        (d, p, first[roots[p]]) for d, p in prints.items()
    }
