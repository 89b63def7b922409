import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortscope.llm.packing import Schedule, cut, op9_packing, pack, pieces
from cohortscope.llm.tokens import vocabulary

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("weights", [None, [1.0, 1.0, 5.0, 0.01, 1e-7]])
def test_schedule_places_every_token_once(weights):
    totals = np.array([50_000, 333, 1, 20_011, 4_097])
    schedule = Schedule(totals, totals / totals.sum() if weights is None else np.array(weights), 512, 16)
    seen = np.zeros(totals.sum(), int)
    for q, total in enumerate(totals):
        cuts = np.unique(np.concatenate([[0, total], np.random.default_rng(q).integers(0, total + 1, 40)]))
        sizes = np.diff(cuts)
        doc, start, length, at = cut(schedule, q, cuts[:-1], sizes)
        assert np.bincount(doc, length, len(sizes)).tolist() == sizes.tolist()
        assert (at // 512 == (at + length - 1) // 512).all()
        for a, n in zip(at, length, strict=True):
            seen[a : a + n] += 1
    assert (seen == 1).all()


def test_windows_hold_the_target_mixture():
    totals = np.array([400_000, 100_000, 12_000])
    schedule = Schedule(totals, totals / totals.sum(), 4096, 64)
    share = np.zeros((3, schedule.rounds))
    for q, total in enumerate(totals):
        _, _, length, at = cut(schedule, q, np.array([0]), np.array([total]))
        share[q] = np.bincount(at // 4096, length, schedule.rounds)
    wanted = np.cumsum(np.full((3, schedule.rounds - 1), 4096.0) * (totals / totals.sum())[:, None], axis=1)
    assert (np.abs(np.cumsum(share[:, :-1], axis=1) - wanted) <= 4 * 64).all()


def test_many_sources_with_their_own_targets_in_bounded_memory():
    rng = np.random.default_rng(1)
    totals, weights = rng.integers(1, 60, 20_000), rng.random(20_000) + 0.01
    totals[77] = 9_000
    tracemalloc.start()
    schedule = Schedule(totals, weights)
    placed = {q: cut(schedule, q, np.array([0]), totals[[q]]) for q in (0, 77, 19_999)}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6
    # A plain statement of the same rounds: what each queue has been served after every round.
    rounds = np.arange(schedule.rounds + 1)
    served = np.stack([schedule.served(np.arange(20_000), np.full(20_000, r)) for r in rounds])
    assert (np.diff(served, axis=0) >= 0).all() and (served[-1] == totals).all()
    for q, (_, start, length, at) in placed.items():
        assert length.sum() == totals[q]
        for a, n, place in zip(start, length, at, strict=True):
            r = np.searchsorted(served[:, q], a, side="right") - 1
            before = served[r].sum() + (served[r + 1, :q] - served[r, :q]).sum()
            assert place == before + a - served[r, q] and n <= 4096


def test_earned_tokens_are_the_sum_over_queues():
    rng = np.random.default_rng(2)
    totals, weights = rng.integers(1, 500, 300), rng.random(300) + 0.01
    schedule = Schedule(totals, weights)
    plain = np.minimum(totals[:, None], weights[:, None] * schedule.times).sum(axis=0)
    assert np.allclose(schedule.earned, plain, rtol=1e-12) and schedule.earned[-1] == totals.sum()


def check(rows, docs):
    tokenizer = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    ids = {d: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for d, t in docs}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length])
        by_doc[r.doc_id].append((r.start, r.length))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(ids)
    for d, spans in by_doc.items():
        assert sum(n for _, n in spans) == len(ids[d])
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(spans), sorted(spans)[1:], strict=False))
    fill = {}
    for s, spans in by_sequence.items():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
        fill[s] = spans[-1][0] + spans[-1][1]
    assert sorted(fill) == list(range(len(fill)))
    assert all(n == 4096 for s, n in fill.items() if s < len(fill) - 1)


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    check(op9_packing(spark, SF_DIR).collect(), docs)


def test_odd_rows_and_clashing_columns(spark):
    rows = [(1, None, None, 3, "p"), (2, "", "a", 4, "p"), (3, "x " * 9000, None, 5, None), (4, "One, two.", "a", None, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, offset long, part string")
    check(pieces(docs).collect(), [(r[0], r[1]) for r in rows])
    again = docs.union(docs).withColumn("doc_id", F.lit(None).cast("long"))
    assert pieces(again).agg(F.sum("length")).first()[0] == 2 * pieces(docs).agg(F.sum("length")).first()[0]


def test_empty_table_and_missing_target(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert pieces(docs).count() == 0
    one = spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string")
    with pytest.raises(ValueError):
        pack(one, vocabulary("word_bpe_49k.json"), {"other": 1.0})
