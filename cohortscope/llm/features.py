"""Hashed features of texts as sparse rows, and models that score them as sparse dot products.

A text's words are found once per batch, each distinct word is turned into numbers once, and n-grams
are combined from those numbers. A batch of texts becomes three arrays: the row of each feature, its
index below ``2**bits``, and how often it occurs in the row.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from cohortscope.llm.base import held_out, rebatched, written

#: Odd multipliers that mix the numbers of an n-gram's words.
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_REPEATED = re.compile(rb"(.)\1+", re.S)
_SHAPE = bytes(
    ord("A") if 65 <= i <= 90 else ord("a") if 97 <= i <= 122 or i >= 128 else ord("9") if 48 <= i <= 57 else i
    for i in range(256)
)
#: Characters of texts held as features at a time.
SLICE = 2_000_000
#: Bytes of all texts of one training sample. The features of a text take at most about five times its bytes.
MAX_BYTES = 48 << 20


@dataclass
class Sparse:
    """Features of ``n`` texts: ``rows`` ascending, ``index`` ascending within a row."""

    n: int
    rows: np.ndarray
    index: np.ndarray
    counts: np.ndarray


def word_number(word: bytes) -> int:
    return zlib.crc32(word.lower())


def shape_number(word: bytes) -> int:
    """Of a word's outline: capitals, small letters, digits and marks, each run once."""
    return zlib.crc32(_REPEATED.sub(rb"\1", word.translate(_SHAPE)), 1)


def plain_number(word: bytes) -> int:
    """Of a word without the marks around it."""
    return zlib.crc32(word.strip(b".,!?;:|*$%&#\"'()").lower(), 2)


def beginning_number(word: bytes) -> int:
    """Of the first five letters of a word, without the marks around it."""
    return zlib.crc32(word.strip(b".,!?;:|*$%&#\"'()").lower().decode("utf-8", "replace")[:5].encode(), 3)


def extract(
    texts: pa.Array, bits: int, streams: Sequence[tuple[Callable[[bytes], int], int]], repeats: bool = False
) -> Sparse:
    """n-grams of the words' numbers: ``streams`` has functions of a word with the longest n-gram.

    ``repeats`` adds a feature for words that equal the word before them. Null texts have no feature.
    """
    split = pc.utf8_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
    words = split.flatten().dictionary_encode()
    which = words.indices.to_numpy(zero_copy_only=False)
    distinct = [w.encode("utf-8", "surrogatepass") for w in words.dictionary.to_pylist()]
    bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
    rows = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(bounds))
    filled = np.array([bool(w) for w in distinct], dtype=bool)[which] if distinct else np.zeros(0, bool)
    which, rows = which[filled], rows[filled]
    drop, keys = np.uint64(64 - bits), []
    for kind, (number, longest) in enumerate(streams):
        one = np.fromiter(map(number, distinct), np.uint64, len(distinct))[which]
        gram, own = one, rows
        for n in range(1, longest + 1):
            if n > 1:
                gram = gram[:-1] * MIX[0] + one[n - 1 :]
                own = own[:-1]
            inside = own == rows[n - 1 :]
            mixed = (gram[inside] + np.uint64(kind * 8 + n)) * MIX[1]
            mixed ^= mixed >> np.uint64(29)
            keys.append((own[inside] << np.uint64(bits)) | ((mixed * MIX[0]) >> drop))
    if repeats:
        again = (which[1:] == which[:-1]) & (rows[1:] == rows[:-1])
        keys.append((rows[1:][again] << np.uint64(bits)) | np.uint64(7))
    found, counts = np.unique(np.concatenate(keys), return_counts=True)
    mask = np.uint64((1 << bits) - 1)
    return Sparse(len(texts), (found >> np.uint64(bits)).astype(np.int64), (found & mask).astype(np.int64), counts)


def sampled(docs: DataFrame, chosen: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The texts of ``chosen`` (doc_id and more, a bounded number of rows) that a model is fitted on.

    One text per id, the one of smallest hash; in the order of the ids' hashes as many as have
    ``max_bytes`` together. Texts above a hundredth of that come after all others, so that a few very long ones
    don't take the place of the rest, and a text above ``max_bytes`` is never part of a sample. Returns the
    columns of ``chosen`` with text and its hash ``h``.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(chosen, "doc_id").withColumn("h", F.coalesce(F.xxhash64("text"), F.lit(0)))
    found = written(texts.withColumn("bytes", F.coalesce(F.octet_length("text"), F.lit(0))), "sample")
    # No more rows than ``chosen`` has, and no text: one task orders them.
    sizes = found.groupBy("doc_id").agg(F.min(F.struct("h", "bytes")).alias("first")).select("doc_id", "first.*")
    order = Window.orderBy(F.col("bytes") > max_bytes // 100, F.xxhash64("doc_id"), "doc_id")
    fits = sizes.withColumn("total", F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    fits = fits.filter(F.col("total") <= max_bytes).select("doc_id", "h")
    kept = found.join(fits, ["doc_id", "h"]).dropDuplicates(["doc_id", "h"])
    return kept.select(*texts.columns)


def labelled(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, max_bytes: int = MAX_BYTES) -> DataFrame:
    """At most ``max_rows`` training texts with their label, the ones of smallest hash of the id.

    Rows of the held-out fold and rows without a label are left out before. The sample is the same on
    every run. Ids select and order rows here; they are no input of a score.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    return sampled(docs, known, max_bytes)


def packed(df: DataFrame, featurise: Callable[[pa.Array], Sparse], *kept: str, counted: bool = True) -> list[tuple]:
    """Features of a bounded sample, for a model fitted on the driver: one tuple of arrays per slice.

    Only indices and, if ``counted``, counts travel, not texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches, "text", SLICE):
            x = featurise(batch.column("text"))
            sizes = np.bincount(x.rows, minlength=x.n).astype("<i4")
            own = [batch.column(k).to_numpy(zero_copy_only=False).astype("<i8").tobytes() for k in kept]
            counts = x.counts.astype("<i4").tobytes() if counted else b""
            parts = [sizes.tobytes(), x.index.astype("<i4").tobytes(), counts, *own]
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.binary()) for p in parts], names=names)

    names = ["sizes", "features", "counts", *(f"k{i}" for i in range(len(kept)))]
    rows = df.select("text", *kept).mapInArrow(run, ", ".join(f"{n} binary" for n in names)).collect()
    kinds = ["<i4", "<i4", "<i4", *["<i8"] * len(kept)]
    return sorted(
        (tuple(np.frombuffer(v, k) for v, k in zip(r, kinds, strict=True)) for r in rows),
        key=lambda t: (t[3].tobytes() if kept else b"", t[1].tobytes()),
    )


def scored(
    docs: DataFrame, featurise: Callable[[pa.Array], Sparse], score: Callable[[Sparse], np.ndarray]
) -> DataFrame:
    """Every row of ``docs`` with a ``score`` column; its other columns pass unchanged."""
    base = [c for c in docs.columns if c != "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches, "text", SLICE):
            values = np.clip(score(featurise(batch.column("text"))), 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], names=[*base, "score"])

    plain = docs.select(*base)
    schema = StructType([*plain.schema.fields, StructField("score", DoubleType())])
    return plain.mapInArrow(run, schema)


def fold_columns(doc_id: Column) -> Column:
    return held_out(doc_id).alias("held_out")
