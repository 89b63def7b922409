import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortscope.llm.sentence_spans import MAX_SENTENCE, MIN_SENTENCE, MIN_WORDS, SPAN, remove_repeated, sentences

SCHEMA = "doc_id long, text string, id string, n_removed string, c0 int"


def brute(rows):
    """doc_id, text of each row after removal, by comparing spans as texts in order."""
    cut = [sentences(t)[0] if t else [] for _, t in rows]
    plain = [[" ".join(s.lower().split()) for s in c] for c in cut]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    first, gone = {}, [set() for _ in rows]
    for i in order:
        own = set()
        for p in range(len(plain[i]) - SPAN + 1):
            text = tuple(plain[i][p : p + SPAN])
            if sum(len(s.split()) for s in text) < MIN_WORDS:
                continue
            if first.setdefault(text, rows[i][0]) != rows[i][0] or text in own:
                gone[i] |= set(range(p, p + SPAN))
            own.add(text)
    return [
        (d, "".join(s for j, s in enumerate(c) if j not in g).rstrip() if g else t, len(g))
        for (d, t), c, g in zip(rows, cut, gone, strict=True)
    ]


@given(st.text(alphabet="ab .!?\n\t", max_size=400))
@settings(max_examples=200, deadline=None)
def test_sentences_give_the_text_back(text):
    found, sizes = sentences(text)
    assert "".join(found) == text
    assert sizes == [len(s.split()) for s in found]
    assert all(n <= MAX_SENTENCE for n in sizes)


def passage(seed, n=5):
    r = random.Random(seed)
    return " ".join(" ".join(f"w{r.randrange(10**6)}" for _ in range(r.randrange(MIN_SENTENCE + 1, 25))) + "." for _ in range(n))


def test_repeated_passage_stays_once(spark):
    shared = passage(0)
    texts = [f"{passage(i)} {shared} {passage(100 + i)}" for i in range(1, 9)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in remove_repeated(docs).collect()}
    assert got[0].text == texts[0] and got[0].n_removed == 0
    for i in range(1, 8):
        assert got[i].text == f"{passage(i + 1)} {passage(101 + i)}"


def test_odd_rows_against_brute_force(spark):
    a, b = passage(1), passage(2)
    rows = [
        (7, f"{a}\n{b}"), (3, None), (4, ""), (None, a), (2, a), (2, a), (9, f"{b} {b}"), (1, "No. Yes. No. Yes. No. Yes."),
        (5, " ".join(["word"] * 3000)), (6, a.upper()), (8, "x"), (None, None),
    ]
    docs = spark.createDataFrame([(d, t, "i", "r", 1) for d, t in rows], SCHEMA)
    got = remove_repeated(docs)
    assert got.columns == ["doc_id", "text", "id", "c0", "n_sentences", "n_removed"]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(((r.doc_id, r.text, r.n_removed) for r in got.collect()), key=key) == sorted(brute(rows), key=key)


def test_empty_table(spark):
    assert remove_repeated(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("sf", ["0.001"])
def test_whole_table_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((r.doc_id, r.text, r.n_removed) for r in remove_repeated(docs).collect())
    assert got == sorted(brute(rows))
    assert any(n for _, _, n in got)


@pytest.mark.parametrize("lengths", [(60,), (28, 28), (5, 5, 5, 5)])
def test_a_passage_is_cut_alike_behind_any_words(lengths):
    r = random.Random(3)
    shared = " ".join(" ".join(f"w{r.randrange(10**6)}" for _ in range(n)) + "." for n in lengths)

    def runs(text):
        plain = [" ".join(s.split()) for s in sentences(text)[0]]
        return {tuple(plain[i : i + SPAN]) for i in range(len(plain) - SPAN + 1)}

    alone = runs(shared)
    for before in range(1, 40):
        assert alone & runs(" ".join(f"x{before}y{i}" for i in range(before)) + " " + shared), before
    assert alone & runs("No. " + shared)


@pytest.mark.parametrize("words", [1, 2, 3])
def test_lists_of_short_lines(spark, words):
    lines = "\n".join(" ".join(f"w{i}x{j}" for j in range(words)) for i in range(200))
    docs = spark.createDataFrame([(1, lines), (2, "Here is another beginning.\n" + lines)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in remove_repeated(docs).collect()}
    assert got == {1: lines, 2: "Here is another beginning."}


def test_rows_of_one_id_and_other_texts(spark):
    """Each row loses its own repetitions only, and rows of one id or none repeat each other."""
    a, b, c, d = (passage(i) for i in range(20, 24))
    rows = [(2, a), (None, a), (None, b), (None, f"{c} {d}"), (None, f"{d} {c}"), (5, f"{b}\n{c}"), (5, d)]
    got = remove_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    left = sorted((str(r.doc_id), r.text) for r in got)
    expected = [("2", a), ("5", f"{b}\n{c}"), ("5", d), *[("None", "")] * 4]
    assert left == sorted(expected)
    e, f = passage(30), passage(31)
    got = remove_repeated(spark.createDataFrame([(None, f"{e} {f}"), (None, f), (1, "x")], "doc_id long, text string"))
    assert sum(r.text.count(f) for r in got.collect()) == 1
