import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cohortscope.llm import tokens
from cohortscope.llm.token_counts import count_tokens, op10_token_counts, read_cache, tokenizer_version
from cohortscope.llm.token_files import op5_token_files, read_token_files, write_token_files
from cohortscope.llm.tokens import encoder, vocabulary

SF_DIR = "/root/testdata/sf0.001"
WORDS = vocabulary("word_bpe_49k.json")
PIECES = vocabulary("piece_bpe_32k.model")
PLAIN = Tokenizer.from_file(WORDS)
ODD = [
    "a<|endoftext|>b x", "<|ENDOFTEXT|>", "it's. don't, 'S. x'.", "a\x1cb c", "é. ́x", "...,", "x..,y.", "Σας. ΣΑΣ", "İx. İ",
    "1.2. 3,", "", None, " \n ", "<|startoftext|> z", "ǅ. ª.", " <|", "|> <| a.", "a\u0085b c　e", "a​b K. क़. q<|", "x!?--y!!! Z***",
]


def whole(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


def pieces(texts):
    ids, offsets = encoder(WORDS).encode(pa.array(texts, pa.string()))
    return [ids[a:z].tolist() for a, z in zip(offsets[:-1], offsets[1:], strict=True)]


def test_texts_encode_as_in_one_piece(monkeypatch):
    assert pieces(ODD) == [whole(t) for t in ODD]
    monkeypatch.setattr(tokens, "ENCODED", 2)
    assert pieces(ODD) == [whole(t) for t in ODD]
    spaces = [f"a{chr(c)}b.{chr(c)} {chr(c)}." for c in range(1, 0x3100)]
    assert pieces(spaces) == [whole(t) for t in spaces]
    assert pieces([]) == [] and pieces([None]) == [[]]


@given(st.lists(st.text(max_size=40), max_size=5))
@settings(max_examples=200, deadline=None)
def test_any_text_encodes_as_in_one_piece(texts):
    assert pieces(texts) == [whole(t) for t in texts]


BYTES = vocabulary("byte_bpe_50k.json")
ANY_CASE = Tokenizer.from_file(BYTES)


@given(st.lists(st.one_of(st.none(), st.text(max_size=40), st.sampled_from([t for t in ODD if t])), max_size=5))
@settings(max_examples=100, deadline=None)
def test_a_vocabulary_with_other_rules_encodes_whole_texts(texts):
    ids, offsets = encoder(BYTES).encode(pa.array(texts, pa.string()))
    want = [ANY_CASE.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [ids[a:z].tolist() for a, z in zip(offsets[:-1], offsets[1:], strict=True)] == want
    assert encoder(WORDS).by_pieces and not encoder(BYTES).by_pieces


def test_whole_texts_in_groups(spark, tmp_path, monkeypatch):
    texts = ["Hello world again.", None, "  Two  spaces\n", "", "LONG tail " * 3000]
    want = [ANY_CASE.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert want[0] == [15496, 995, 757, 13]
    monkeypatch.setattr(tokens, "WHOLE", 5)
    ids, offsets = encoder(BYTES).encode(pa.array(texts, pa.string()))
    assert [ids[a:z].tolist() for a, z in zip(offsets[:-1], offsets[1:], strict=True)] == want
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    write_token_files(docs, str(tmp_path / "bytes"), BYTES)
    got = read_token_files(spark, str(tmp_path / "bytes")).orderBy("doc_id").collect()
    assert [list(r.ids) for r in got] == [[*w, 2] for w in want]


ROWS = [(5, "One two."), (2, None), (None, "null id"), (9, ""), (2, "second"), (2, "second"), (7, "w " * 5000)]
SCHEMA = "doc_id long, text string, part string, start long, content string"


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files_round_trip(spark, tmp_path, encoding):
    docs = spark.createDataFrame([(d, t, "p", 1, "c") for d, t in ROWS], SCHEMA)
    path = str(tmp_path / encoding)
    write_token_files(docs, path, WORDS, encoding=encoding, row_group_bytes=1 << 20, page_bytes=4096)
    got = read_token_files(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 2, 2, 2, 5, 7, 9]
    assert sorted(str((r.doc_id, r.ids)) for r in got) == sorted(str((d, [*whole(t), 2])) for d, t in ROWS)
    at = 0
    for r in got:
        assert (r.start, r.n_tokens) == (at, len(r.ids))
        at += r.n_tokens
    some = read_token_files(spark, path, ["doc_id", "n_tokens"]).filter("doc_id = 7")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1] and "EqualTo(doc_id,7)" in plan
    assert some.first().n_tokens == len(whole("w " * 5000)) + 1


def test_files_of_an_empty_table(spark, tmp_path):
    write_token_files(spark.createDataFrame([], SCHEMA), str(tmp_path / "none"), WORDS)
    assert read_token_files(spark, str(tmp_path / "none")).count() == 0


def test_whole_table_from_files(spark):
    docs = sorted(spark.read.parquet(f"{SF_DIR}/documents.parquet").collect(), key=lambda r: r.doc_id)
    got, at = {r.doc_id: r for r in op5_token_files(spark, SF_DIR).collect()}, 0
    for d in docs:
        ids = np.array([*whole(d.text), 2], "<u4")
        r = got[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids))
        at += len(ids)


def counted(texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    return [len(model.encode(t or "")) for t in texts]


def test_counts_through_the_cache(spark, tmp_path):
    cache = str(tmp_path / "cache")
    docs = spark.createDataFrame([(d, t, "p", 1, "c") for d, t in ROWS], SCHEMA)
    want = sorted(
        str((d, len((t or "").encode()), n)) for (d, t), n in zip(ROWS, counted([t for _, t in ROWS]), strict=True)
    )
    assert sorted(str(tuple(r)) for r in count_tokens(docs, PIECES, cache).collect()) == want
    stored = read_cache(spark, cache, tokenizer_version(PIECES))
    assert stored.count() == 5
    # What is stored is believed: a hit isn't encoded again, and only the new text is appended.
    more = docs.union(spark.createDataFrame([(11, "something new", "p", 1, "c")], SCHEMA))
    assert count_tokens(more, PIECES, cache).count() == len(ROWS) + 1
    assert spark.read.parquet(cache).count() == 6
    assert count_tokens(docs, WORDS, cache).filter("doc_id = 5").first().n_tokens == len(whole("One two."))
    assert spark.read.parquet(cache).groupBy("tokenizer").count().count() == 2
    assert count_tokens(docs.limit(0), PIECES, str(tmp_path / "other")).count() == 0


def test_whole_table_counts(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    got = {r.doc_id: r for r in op10_token_counts(spark, SF_DIR).collect()}
    for d, n in zip(docs, counted([d.text for d in docs]), strict=True):
        r = got[d.doc_id]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(d.text.encode()), n, n > 4096)
    assert len(got) == len(docs)
