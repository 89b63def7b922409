"""Runs of words that repeat with a period, found by internal pattern matching.

A run is a stretch of consecutive words with smallest period q, so that words q apart are equal, of at least
``MIN_LENGTH`` words and ``MIN_REPEATS`` periods, which can't be extended by a word on either side. Of each run the
first period stays in the collapsed text and the rest goes.

For every k the text has blocks of 2**k words, one after the other. If q lies in [2**k, 2**(k+1)), a run holds such a
block in its first two periods, and the block occurs again q words on, in the neighbouring window of 2**k
starts. A block is an interval of the suffix array; a wavelet tree over the suffix array answers, for all
blocks at once, how many of the interval's suffixes start in the window and which come first and next. Occurrences
of a block in a window of its own length form an arithmetic progression. One or two of them are candidate
periods as they stand; of three or more only that one can be which shifts the end of the block's own repetition
onto the end of the repetition it comes back in. Candidates are extended to both sides by the ranks of
prefix doubling, words against words, and short ones drop out. So a text of n words costs n log n.

The suffixes of many texts are sorted at once: words are numbered apart for each text, and every text ends in
a mark of its own, so that no match crosses texts. A document is a row and is never shuffled; tasks hold about
``MAX_CHARS`` characters of texts at a time, or one longer text.

Defined results: words are what blanks, tabs and line ends (0x20, 0x09 to 0x0D) separate, compared as they are; a
null, empty or blank text has no words, no runs and an empty collapsed text; the collapsed text of others is their
kept words joined by one space; runs come by start, then period; equal rows have equal results; an empty table
gives no rows; further columns pass unchanged, and those named ``runs`` or ``collapsed`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.types import _parse_datatype_string as parse_type

from cohortscope.llm.base import query, rebatched, table

MIN_LENGTH = 6
#: The block argument above needs four periods at least.
MIN_REPEATS = 4
MAX_CHARS = 2_000_000
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
BLANKS = r"[\x20\x09-\x0D]+"


class WaveletTree:
    """How many, and which, of the values of a stretch of an array lie below a bound."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.zeros = bits, []
        for shift in range(bits - 1, -1, -1):
            low = (values >> shift) & 1 == 0
            self.zeros.append(np.concatenate([[0], np.cumsum(low, dtype=np.int32)]).astype(np.int32))
            values = np.concatenate([values[low], values[~low]])

    def below(self, left: np.ndarray, right: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Number of values under ``bound`` (less than 2**bits) in [left, right)."""
        count = np.zeros(len(left), np.int64)
        for level, zeros in enumerate(self.zeros):
            high = (bound >> (self.bits - 1 - level)) & 1 == 1
            l0, r0 = zeros[left], zeros[right]
            count += np.where(high, r0 - l0, 0)
            left = np.where(high, zeros[-1] + left - l0, l0)
            right = np.where(high, zeros[-1] + right - r0, r0)
        return count

    def smallest(self, left: np.ndarray, right: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value with ``k`` smaller ones in [left, right)."""
        value, k = np.zeros(len(left), np.int64), k.copy()
        for level, zeros in enumerate(self.zeros):
            l0, r0 = zeros[left], zeros[right]
            high = k >= r0 - l0
            k -= np.where(high, r0 - l0, 0)
            value += high.astype(np.int64) << (self.bits - 1 - level)
            left = np.where(high, zeros[-1] + left - l0, l0)
            right = np.where(high, zeros[-1] + right - r0, r0)
        return value


class Suffixes:
    """Suffix array of numbered words by prefix doubling, with the ranks of every step.

    ``ranks[k]`` is equal for two places if the 2**k words from there are. ``blocks`` are the aligned blocks that
    occur elsewhere in their text: size, place, and first and last slot of their interval.
    """

    def __init__(self, words: np.ndarray, place: np.ndarray, room: np.ndarray):
        n = len(words)
        self.order = np.argsort(words, kind="stable")
        found = words[self.order]
        first = np.concatenate([[True], found[1:] != found[:-1]])
        rank = np.empty(n, np.int32)
        rank[self.order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        self.ranks, blocks, size = [rank], [], 1
        while True:
            starts = np.flatnonzero(first)
            sizes = np.diff(np.append(starts, n))
            slots = np.flatnonzero(np.repeat(sizes > 1, sizes))
            if not len(slots):
                break
            at = self.order[slots]
            begin = rank[at]
            # A block that recurs has no end mark in it, so the place behind it exists.
            aligned = (place[at] % size == 0) & (room[at] >= MIN_REPEATS * size)
            ends = np.repeat(starts + sizes, sizes)[slots]
            blocks.append(np.stack([np.full(int(aligned.sum()), size), at[aligned], begin[aligned], ends[aligned]]))
            key = begin.astype(np.int64) * n + rank[at + size]
            by_key = np.argsort(key, kind="stable")
            key = key[by_key]
            self.order[slots] = at[by_key]
            first[slots] = np.concatenate([[True], key[1:] != key[:-1]])
            rank = rank.copy()
            rank[self.order[slots]] = np.maximum.accumulate(np.where(first[slots], slots, 0))
            self.ranks.append(rank)
            size *= 2
        self.blocks = np.concatenate(blocks, axis=1) if blocks else np.zeros((4, 0), np.int64)

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words from i and j on."""
        start, i, j = i, i.copy(), j.copy()
        for k in range(len(self.ranks) - 1, -1, -1):
            step = (self.ranks[k][i] == self.ranks[k][j]).astype(np.int64) << k
            i += step
            j += step
        return i - start

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words before i and j."""
        start, i, j = i, i.copy(), j.copy()
        for k in range(len(self.ranks) - 1, -1, -1):
            a, b = i - (1 << k), j - (1 << k)
            inside = a >= 0
            same = inside & (self.ranks[k][np.where(inside, a, 0)] == self.ranks[k][np.where(inside, b, 0)])
            i, j = np.where(same, a, i), np.where(same, b, j)
        return start - i


def find_runs(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows (text, start, length, period) of all runs, by text, start and period.

    ``words`` are the numbered words of all texts, ``bounds`` where each text begins and the last ends.
    """
    sizes = np.diff(bounds)
    if len(words) == 0:
        return np.zeros((4, 0), np.int64)
    # Behind each text stands a mark; words of different texts get different numbers.
    text = np.repeat(np.arange(len(sizes)), sizes + 1)
    begin = (bounds[:-1] + np.arange(len(sizes)))[text]
    place = np.arange(len(text)) - begin
    mark = place == sizes[text]
    kinds = int(words.max()) + 2
    numbers = np.full(len(text), kinds - 1, np.int64)
    numbers[~mark] = words
    suffixes = Suffixes(numbers + text * kinds, place, sizes[text])
    size, at, left, right = suffixes.blocks
    bits = (int(place.max()) + 1).bit_length()
    tree = WaveletTree(place[suffixes.order].astype(np.int32), bits)
    end = sizes[text[at]]
    low = tree.below(left, right, np.minimum(place[at] + size, end))
    high = tree.below(left, right, np.minimum(place[at] + 2 * size, end))
    hit = high > low
    size, at, left, right, low, count = (x[hit] for x in (size, at, left, right, low, high - low))
    one = at - place[at] + tree.smallest(left, right, low)
    more = count > 1
    two = one.copy()
    two[more] = (at - place[at])[more] + tree.smallest(left[more], right[more], low[more] + 1)
    many = count > 2
    lone = ~many
    step = (two - one)[many]
    own = at[many] + step + suffixes.forward(at[many], at[many] + step)
    again = one[many] + step + suffixes.forward(one[many], one[many] + step)
    second = lone & more
    starts = np.concatenate([at[lone], at[second], at[many]])
    periods = np.concatenate([(one - at)[lone], (two - at)[second], again - own])
    fits = (periods > 0) & (periods < 2 * np.concatenate([size[lone], size[second], size[many]]))
    starts, periods = starts[fits], periods[fits]
    begins = starts - suffixes.backward(starts, starts + periods)
    ends = starts + periods + suffixes.forward(starts, starts + periods)
    long = ends - begins >= np.maximum(MIN_LENGTH, MIN_REPEATS * periods)
    begins, ends, periods = begins[long], ends[long], periods[long]
    # Multiples of a run's period describe the same stretch: the smallest stays.
    order = np.lexsort((periods, ends, begins))
    begins, ends, periods = begins[order], ends[order], periods[order]
    kept = np.ones(len(begins), bool)
    kept[1:] = (begins[1:] != begins[:-1]) | (ends[1:] != ends[:-1])
    begins, ends, periods = begins[kept], ends[kept], periods[kept]
    order = np.lexsort((periods, begins))
    found = np.stack([text[begins], place[begins], ends - begins, periods])
    return found[:, order]


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, and where each text begins and the last ends."""
    split = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
    flat = split.flatten()
    bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
    full = pc.greater(pc.binary_length(flat), 0)
    if pc.all(full).as_py() is not False:
        return flat, bounds
    kept = full.to_numpy(zero_copy_only=False)
    return flat.filter(full), np.concatenate([[0], np.cumsum(kept)])[bounds]


def _annotate(text_at: int, kept_at: list[int], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches, f"c{text_at}", MAX_CHARS):
            words, bounds = split_words(batch.column(text_at))
            codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            text, start, length, period = find_runs(codes, bounds)
            # A word goes if a run covers it after that run's first period.
            change = np.zeros(len(codes) + 1, np.int64)
            np.add.at(change, bounds[text] + start + period, 1)
            np.add.at(change, bounds[text] + start + length, -1)
            stays = np.cumsum(change[:-1]) == 0
            if len(text):
                ends = np.concatenate([[0], np.cumsum(stays)])[bounds]
                words = words.filter(pa.array(stays))
            else:
                ends = bounds
            lists = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), words)
            collapsed = pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())
            rows = np.searchsorted(text, np.arange(batch.num_rows + 1))
            runs = pa.ListArray.from_arrays(
                pa.array(rows, pa.int32()),
                pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"]),
            )
            columns = [batch.column(i) for i in kept_at] + [runs, collapsed]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``runs`` (start, length, period; places are word numbers from 0) and ``collapsed``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = [i for i, c in enumerate(docs.columns) if c not in ("runs", "collapsed")]
    # Positional names keep clear of whatever the input's columns are called.
    inner = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = docs.columns.index(text)
    inner = inner.withColumn(f"c{at}", F.col(f"c{at}").cast("string"))
    fields = [StructField(docs.columns[i], inner.schema[i].dataType) for i in kept]
    schema = StructType([*fields, StructField("runs", parse_type(RUNS)), StructField("collapsed", StringType())])
    plain = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(schema.fields)])
    return inner.mapInArrow(_annotate(at, kept, to_arrow_schema(plain)), plain).toDF(*schema.names)


def with_repetitions(doc_id: Column, text: Column) -> Column:
    """The text, in a tenth of the documents with its end replaced by repetitions of earlier words.

    A fixed rule on crc32 of the id decides which documents, from where on and with what period. Rows without an id
    stay as they are.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        places = F.sequence(F.lit(0).cast("long"), n - F.lit(1).cast("long"))
        again = F.transform(places, lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
        return F.when(n > 0, F.array_join(again, " "))

    # The words are made once and bound to a name, not once for each place.
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    changed = F.get(F.transform(F.array(words), repeated), 0)
    return F.when(h % 10 == 0, F.coalesce(changed, text)).otherwise(text)


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of runs, the longest run, and digests of all runs and the collapsed text, per document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", with_repetitions(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic_runs(docs)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length, -r.start, -r.period)))
    best = found.withColumn("best", longest)
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    length, start, period = F.col("best.length"), -F.col("best.col2"), -F.col("best.col3")
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(F.lit(1000) * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
