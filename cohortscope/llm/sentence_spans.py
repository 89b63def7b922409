"""Substring deduplication by sliding sentence spans.

A text is cut into sentences. Every run of ``SPAN`` consecutive sentences with at least ``MIN_WORDS`` words
is hashed to 128 bits over small letters and single spaces. Equal hashes meet across all documents; of each
repeated span the first occurrence, by ``doc_id``, then the text's hash and place, stays, and every sentence
that lies in a later occurrence is removed. Repetitions within a text are found where it is hashed.

A sentence ends at full stops, exclamation or question marks before white space, and at line ends. A row
of sentences of fewer than ``MIN_SENTENCE`` words is taken together, and one or two words alone go with the
next sentence if that has at most ``2 * MIN_SENTENCE``, so that a span can't fall short. What has more than ``MAX_SENTENCE`` words, and every such row, is cut where its words say so: after each word whose hash
is below those of ``MIN_SENTENCE`` words on either side, and in what is still too long after the lowest hash in
reach. So a passage that begins anywhere in a sentence is soon cut alike in any document.

Texts are cut and hashed once; hashes and places of the spans are a table in the shared folder, with a row for
each text's number of sentences. Only these are shuffled to find repetitions. The first document of a hash is
kept by an aggregation that starts before the shuffle, so a span that a third of all documents share is a row per
task; joining all spans to the repeated hashes, a hot hash can be split over tasks. Texts move once, to meet the places to
remove, which come as characters, so that nothing is cut again.

Defined results: null and empty texts stay as they are; a null ``doc_id`` comes after all others; rows of
equal ``doc_id`` and text count as one document and don't repeat each other, those of equal ``doc_id`` (or
none) and other text do; texts without a removed sentence come back unchanged, byte for byte; a text whose
sentences all go becomes empty; an empty table gives no rows; other columns pass unchanged whatever their
names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from cohortscope.llm.base import query, rebatched, table, written

SPAN = 3
MIN_SENTENCE = 3
MIN_WORDS = SPAN * MIN_SENTENCE
MAX_SENTENCE = 16
END = re.compile(r"[.!?]+\s+|\n\s*")
WORD = re.compile(r"\S+\s*")
#: A row of place -1 has the text's number of sentences as its stop.
SPANS_SCHEMA = "h1 long, h2 long, id long, t long, place int, start int, stop int, again boolean"
#: Odd multipliers that put the hashes of a span's sentences in order.
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
LAST = (1 << 63) - 1


class _Keys(dict):
    """Hashes of words, kept for a bounded number of them."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 17:
            self.clear()
        self[word] = key = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return key


KEYS = _Keys()


def _cuts(words: list[str]) -> list[int]:
    """Where a long sentence or a row of short ones is cut, as numbers of words, with its end."""
    least, n = MIN_SENTENCE + 1, len(words)
    k = [KEYS[w] for w in words]
    cuts, low = [], 0
    lowest = [
        i + 1
        for i in range(least - 1, n - least)
        if k[i] < k[i - 1] and k[i] < k[i + 1] and k[i] < min(k[i - MIN_SENTENCE : i]) and k[i] < min(k[i + 1 : i + least])
    ]
    for high in [*lowest, n]:
        while high - low > MAX_SENTENCE:
            reach = k[low + least - 1 : min(low + MAX_SENTENCE, high - least)]
            low += least + reach.index(min(reach))
            cuts.append(low)
        cuts.append(high)
        low = high
    return cuts


def sentences(text: str) -> tuple[list[str], list[int]]:
    """The raw sentences of a text, which joined give it back, and their numbers of words."""
    found, sizes = [], []

    def add(begin: int, end: int, cut: bool) -> None:
        words = text[begin:end].lower().split()
        if not cut and len(words) <= MAX_SENTENCE:
            found.append(text[begin:end])
            sizes.append(len(words))
            return
        ends, last = [m.end() for m in WORD.finditer(text, begin, end)], 0
        for at in _cuts(words):
            stop = ends[at - 1] if at < len(words) else end
            found.append(text[begin:stop])
            sizes.append(at - last)
            begin, last = stop, at

    begin = last = 0
    for end in [m.end() for m in END.finditer(text)] + [len(text)]:
        if end == last:
            continue
        own = len(text[last:end].split())
        if own >= MIN_SENTENCE:
            before = len(text[begin:last].split())
            if before >= MIN_SENTENCE or before and own > 2 * MIN_SENTENCE:
                add(begin, last, True)
                begin = last
            add(begin, end, False)
            begin = end
        last = end
    if last > begin:
        add(begin, last, True)
    return found, sizes


def _hash_spans(span: int, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_128_digest
        for batch in rebatched(batches, "text", 2_000_000):
            raw, sizes, lengths, counts = [], [], [], []
            for text in batch.column("text").to_pylist():
                found, words = sentences(text) if text else ([], [])
                raw += [digest(" ".join(s.lower().split()).encode("utf-8", "surrogatepass")) for s in found]
                lengths += map(len, found)
                sizes += words
                counts.append(len(found))
            ids, t = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "t"))
            none = np.full(len(counts), -1, np.int32)
            yield _rows(t, ids, ids, t, none, none, np.array(counts, np.int32), np.zeros(len(counts), bool))
            if len(raw) < span:
                continue
            hashes = np.frombuffer(b"".join(raw), "<u8").reshape(-1, 2)
            row = np.repeat(np.arange(len(counts)), counts)
            before = np.cumsum(counts) - counts
            place = np.arange(len(row)) - before[row]
            total = np.cumsum(np.concatenate([[0], sizes]))
            ends = np.cumsum(np.concatenate([[0], lengths]))
            n = len(row) - span + 1
            kept = (row[:n] == row[span - 1 :]) & (total[span:] - total[:n] >= min_words)
            one, two = hashes[:n, 0].copy(), hashes[:n, 1].copy()
            for i in range(1, span):
                one = one * MIX[0] + hashes[i : n + i, 0]
                two = (two ^ (two >> np.uint64(31))) * MIX[1] + hashes[i : n + i, 1]
            at = np.flatnonzero(kept)
            at = at[np.lexsort((place[at], two[at], one[at], row[at]))]
            one, two, row, place = one[at], two[at], row[at], place[at]
            start = ends[at] - ends[before[row]]
            stop = ends[at + span] - ends[before[row]]
            again = np.zeros(len(one), bool)
            again[1:] = (row[1:] == row[:-1]) & (one[1:] == one[:-1]) & (two[1:] == two[:-1])
            yield _rows(one.view(np.int64), two.view(np.int64), ids[row], t[row], place, start, stop, again)

    return run


def _rows(one, two, ids, t, place, start, stop, again) -> pa.RecordBatch:
    numbers = [pa.array(x) for x in (one, two, ids, t)]
    places = [pa.array(x.astype(np.int32)) for x in (place, start, stop)]
    names = ["h1", "h2", "id", "t", "place", "start", "stop", "again"]
    return pa.RecordBatch.from_arrays([*numbers, *places, pa.array(again)], names=names)


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """id (doc_id, null as the last one) and t, a hash of the text, which tells rows of one id apart."""
    return [F.coalesce(doc_id.cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(text).alias("t")]


def spans(docs: DataFrame, span: int = SPAN, min_words: int = MIN_WORDS) -> DataFrame:
    """h1, h2 (the hash), the document's ``row_key``, place and characters of every span.

    ``again`` marks spans that the same text has before.
    """
    text = F.col("text").cast("string")
    rows = docs.select(*row_key(F.col("doc_id"), text), text.alias("text"))
    return rows.mapInArrow(_hash_spans(span, min_words), SPANS_SCHEMA)


def repeated_places(docs: DataFrame, span: int = SPAN, min_words: int = MIN_WORDS) -> DataFrame:
    """``row_key``, place and characters of every occurrence of a span but its first, and the rows of place -1."""
    key = F.struct("id", "t")
    every = written(spans(docs, span, min_words), "spans", compression="zstd")
    first = (
        every.filter("place >= 0 AND NOT again")
        .groupBy("h1", "h2")
        .agg(F.min(key).alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
        .drop("n")
    )
    first = written(first, "repeated-spans")
    later = F.col("again") | (F.col("place") < 0) | F.coalesce(key > F.col("first"), F.lit(False))
    return every.join(first, ["h1", "h2"], "left").filter(later).select("id", "t", "place", "start", "stop")


def _remove(span: int, text_at: int, total_at: int, cut_at: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new, removed = [], []
            for text, cuts in zip(batch.column(text_at).to_pylist(), batch.column(cut_at).to_pylist(), strict=True):
                gone = set()
                if cuts:
                    left, last = [], 0
                    for cut in sorted(cuts, key=lambda c: c["place"]):
                        gone.update(range(cut["place"], cut["place"] + span))
                        if cut["start"] > last:
                            left.append(text[last : cut["start"]])
                        last = max(last, cut["stop"])
                    text = ("".join(left) + text[last:]).rstrip()
                new.append(text)
                removed.append(len(gone))
            columns = [pa.array(new, pa.string()) if i == text_at else c for i, c in enumerate(batch.columns) if i < total_at]
            total = batch.column(total_at).fill_null(0)
            yield pa.RecordBatch.from_arrays([*columns, total, pa.array(removed, pa.int32())], names=names)

    return run


def remove_repeated(docs: DataFrame, span: int = SPAN, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` (doc_id, text, ...) without repeated spans, with n_sentences and n_removed.

    Columns of those names are replaced. Places come together per document, which holds them anyway.
    """
    base = docs.select(*[c for c in docs.columns if c not in ("n_sentences", "n_removed")]).withColumn(
        "text", F.col("text").cast("string")
    )
    cut = F.when(F.col("place") >= 0, F.struct("place", "start", "stop"))
    total = F.max(F.when(F.col("place") < 0, F.col("stop"))).alias("total")
    places = repeated_places(docs, span, min_words).groupBy("id", "t").agg(total, F.collect_set(cut).alias("places"))
    # Positional names keep clear of whatever the input's columns are called.
    inner = base.toDF(*[f"c{i}" for i in range(len(base.columns))])
    doc_id, text = (inner[f"c{base.columns.index(c)}"] for c in ("doc_id", "text"))
    same = [own == places[c] for own, c in zip(row_key(doc_id, text), ("id", "t"), strict=True)]
    joined = inner.join(places, same, "left").drop("id", "t")
    names = [*base.columns, "n_sentences", "n_removed"]
    schema = StructType(
        [*base.schema.fields, StructField("n_sentences", IntegerType()), StructField("n_removed", IntegerType())]
    )
    at = base.columns.index("text")
    return joined.mapInArrow(_remove(span, at, len(base.columns), len(base.columns) + 1, names), schema)


@query("op8_sentence_spans")
def op8_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without sentences of spans that occur before."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeated(docs)
