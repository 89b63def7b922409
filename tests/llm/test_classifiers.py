import math

import numpy as np
import pyarrow as pa
import pytest

from cohortscope.llm import quality, toxicity
from cohortscope.llm.base import is_held_out
from cohortscope.llm.features import MIX, Sparse, extract, packed, sampled, shape_number, word_number
from cohortscope.llm.quality import Ftrl, op7_quality, score_quality
from cohortscope.llm.toxicity import op4_toxicity, score_toxicity

SF_DIR = "/root/testdata/sf0.1"
SCHEMA = "doc_id long, text string, score string, label int"


def test_features_by_hand():
    x = extract(pa.array(["a b a b", None, "", " A  b\n"]), 20, [(word_number, 2)], repeats=True)
    assert x.n == 4 and set(x.rows.tolist()) == {0, 3}
    assert sorted(x.counts[x.rows == 0].tolist()) == [1, 2, 2, 2] and x.counts[x.rows == 3].tolist() == [1, 1, 1]
    assert set(x.index[x.rows == 3]) <= set(x.index[x.rows == 0])
    assert shape_number(b"THTHER!!") == shape_number(b"FOR!") and shape_number(b"for!") != shape_number(b"FOR!")


def test_ftrl_step_by_hand():
    model = Ftrl(1, alpha=0.5, beta=1.0, l1=0.0, l2=0.0)
    model.learn(np.array([0]), np.array([2.0]), 1)
    # Gradient (0.5 - 1) * 2 = -1, so z = -1, n = 1 and w = 1 / ((1 + 1) / 0.5).
    assert model.weights(np.array([0]))[0] == pytest.approx(0.25)
    assert Ftrl(1, l1=5.0).weights(np.array([0]))[0] == 0


def test_non_negative_risk_learns_from_positives_and_unlabelled():
    rng = np.random.default_rng(1)

    def rows(n, share):
        found = [[0, 1] if toxic else [1] for toxic in rng.random(n) < share]
        return [(np.array([len(f) for f in found]), np.concatenate(found), None)]

    column = np.array([0, 1])
    w, b = toxicity.non_negative_pu(toxicity.Rows(rows(300, 1.0), column), toxicity.Rows(rows(3000, 0.1), column), 2, 0.1)
    score = lambda *f: 1 / (1 + math.exp(-(sum(w[i] for i in f) + b)))
    assert score(0, 1) > 0.7 and score(1) < 0.1


def auc(scored):
    order = sorted(scored)
    ranks = {}
    for i, (s, _) in enumerate(order):
        ranks.setdefault(s, []).append(i + 1)
    p = sum(y for _, y in scored)
    total = sum(sum(ranks[s]) / len(ranks[s]) for s, y in scored if y)
    return (total - p * (p + 1) / 2) / (p * (len(scored) - p))


@pytest.mark.parametrize(("query", "label", "least"), [(op7_quality, "quality", 0.99), (op4_toxicity, "toxic", 0.9)])
def test_held_out_accuracy(spark, query, label, least):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    rows = query(spark, SF_DIR).collect()
    assert len({r.doc_id for r in rows}) == len(rows) == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    assert all(r.held_out == is_held_out(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    assert auc([(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]) > least


def test_training_texts_are_bounded_in_bytes(spark):
    rows = [(i, "é" * (10 + i)) for i in range(50)] + [(100 + i, "x" * 5000) for i in range(8)] + [(200, "y" * 10**5)]
    rows += [(7, "another text of 7")] * 3 + [(8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    chosen = spark.createDataFrame([(i, 1) for i in {r[0] for r in rows}], "doc_id long, label int")
    got = sampled(docs, chosen, 10**6).collect()
    assert len(got) == len({r[0] for r in rows}) and {r.doc_id for r in got} == {r[0] for r in rows}
    got = sampled(docs, chosen, 20_000).collect()
    ids = {r.doc_id for r in got}
    assert sum(len((r.text or "").encode()) for r in got) <= 20_000
    # All short texts, and those of the long ones that still fit; never the one that is longer than the bound.
    assert ids >= set(range(50)) and len(ids - set(range(50))) == 3 and 200 not in ids
    assert len(ids) == len(got) and sampled(docs, chosen, 20_000).schema.names == ["doc_id", "text", "label", "h"]
    assert {r.doc_id for r in sampled(docs, chosen, 20_000).collect()} == ids
    assert sampled(docs.limit(0), chosen).count() == 0


def test_very_long_text_is_scored_whole(spark):
    words = [f"plain{i % 97}" for i in range(30_000)]
    bad = [i % 10 == 0 for i in range(300)]
    docs = [(i, f"BAD!! loser LINE!! {i}" if bad[i] else f"good plain words number {i}") for i in range(300)]
    docs += [(1000, " ".join(words)), (1001, " ".join(words + ["loser", "LINE!!"] * 30_000))]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - int(y), int(y)) for i, y in enumerate(bad)], "doc_id long, quality int, toxic int")
    # Only the end of the second text is bad.
    for score, less in ((score_quality, 1001), (score_toxicity, 1000)):
        got = {r.doc_id: r.score for r in score(docs, labels).collect()}
        assert len(got) == 302 and got[less] < got[2001 - less]


def plain_features(text, streams, repeats):
    """Hashed n-grams word by word, with whole numbers of any size."""
    words, found = [w.encode("utf-8", "surrogatepass") for w in (text or "").split()], {}
    for kind, (number, longest) in enumerate(streams):
        for n in range(1, longest + 1):
            for i in range(len(words) - n + 1):
                gram = 0
                for w in words[i : i + n]:
                    gram = (gram * int(MIX[0]) + number(w)) % 2**64
                mixed = (gram + kind * 8 + n) * int(MIX[1]) % 2**64
                mixed ^= mixed >> 29
                index = (mixed * int(MIX[0]) % 2**64) >> 44
                found[index] = found.get(index, 0) + 1
    if repeats:
        again = sum(a == b for a, b in zip(words, words[1:], strict=False))
        if again:
            found[7] = found.get(7, 0) + again
    return found


def test_every_score_of_a_whole_table_against_a_plain_restatement(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    tables = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    streams = {
        quality: ([(word_number, 2), (shape_number, 2)], True),
        toxicity: ([(toxicity.plain_number, 1), (toxicity.beginning_number, 1)], False),
    }
    for module, run in ((quality, op7_quality), (toxicity, op4_toxicity)):
        model = module.fit(*tables)
        got = {r.doc_id: r for r in run(spark, sf).collect()}
        assert len(got) == len(docs)
        for r in docs:
            found = plain_features(r.text, *streams[module])
            index = np.array(sorted(found), np.int64)
            x = Sparse(1, np.zeros(len(index), np.int64), index, np.array([found[i] for i in index.tolist()], np.int64))
            want = float(model(x)[0]) if len(index) else float(model(Sparse(1, index, index, index))[0])
            assert got[r.doc_id].score == pytest.approx(want, abs=1e-6)
            if abs(want - module.THRESHOLD) > 1e-6:
                assert got[r.doc_id].predicted == int(want >= module.THRESHOLD)


def test_training_against_a_plain_restatement(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    parts = packed(quality.labelled(docs, labels, "quality", 60), quality.featurise, "h", "label")
    weights, bias = quality.train(parts)
    size, examples = 1 << quality.BITS, []
    for sizes, index, counts, _, known in parts:
        at = 0
        for n, y in zip(sizes.tolist(), known.tolist(), strict=True):
            v = [math.log1p(c) for c in counts[at : at + n].tolist()]
            norm = math.sqrt(sum(a * a for a in v))
            examples.append(([(i, quality.SCALE * a / norm) for i, a in zip(index[at : at + n].tolist(), v, strict=True)], y))
            at += n
    z, squares = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= 1e-4:
            return 0.0
        return -(z[i] - math.copysign(1e-4, z[i])) / ((1.0 + math.sqrt(squares[i])) / 0.3 + 1e-4)

    shuffle = np.random.default_rng(0)
    for _ in range(2):
        for e in shuffle.permutation(len(examples)):
            x, y = examples[e]
            x = [*x, (size, 1.0)]
            w = {i: weight(i) for i, _ in x}
            off = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x))) - y
            for i, v in x:
                g, n = off * v, squares.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n + g * g) - math.sqrt(n)) / 0.3 * w[i]
                squares[i] = n + g * g
    assert bias == pytest.approx(weight(size), abs=1e-4)
    assert all(weights[i] == pytest.approx(weight(i), abs=1e-4) for i in z if i < size)


@pytest.mark.parametrize(("score", "name"), [(score_quality, "quality"), (score_toxicity, "toxic")])
def test_odd_rows_and_clashing_columns(spark, score, name):
    texts = [(i, f"good plain words number {i}" if i % 2 else f"BAD!! loser LINE!! {i}", "s", i) for i in range(40)]
    texts += [(50, None, None, None), (51, "", "x", 1), (None, "no id", "x", 1), (1, texts[1][1], "s", 1)]
    docs = spark.createDataFrame(texts, SCHEMA)
    known = [(i, i % 2) for i in range(40)] + [(3, 0), (None, 1), (7, None)]
    labels = spark.createDataFrame(known, f"doc_id long, {name} int")
    got = score(docs, labels)
    assert got.columns == ["doc_id", "text", "label", "score"]
    rows = got.collect()
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if not r.text}) == 1
    assert score(docs.limit(0), labels).count() == 0


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 1)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert score_quality(docs, none).first().score == 0.5
    assert score_toxicity(docs, none).first().score == 0.0


@pytest.mark.filterwarnings("error::RuntimeWarning")
def test_toxic_labels_without_texts(spark):
    ids = [i for i in range(20) if not is_held_out(i)]
    docs = spark.createDataFrame([(i, f"words {i}", "s", 1) for i in ids[2:]], SCHEMA)
    labels = spark.createDataFrame([(i, int(i in ids[:2])) for i in ids], "doc_id long, toxic int")
    assert {r.score for r in score_toxicity(docs, labels).collect()} == {0.0}


def test_held_out_labels_change_nothing(spark):
    docs = spark.createDataFrame([(i, f"text {'good' if i % 2 else 'bad'} {i}", "s", i) for i in range(60)], SCHEMA)
    rows = [(i, i % 2) for i in range(60)]
    flipped = [(i, 1 - y if is_held_out(i) else y) for i, y in rows]
    assert rows != flipped
    scores = [
        sorted((r.doc_id, r.score) for r in score_quality(docs, spark.createDataFrame(x, "doc_id long, quality int")).collect())
        for x in (rows, flipped)
    ]
    assert scores[0] == scores[1]
    assert quality.THRESHOLD == 0.7 and toxicity.THRESHOLD == 0.3
