"""Removal of repeated byte strings by a sparse suffix sort with hash comparisons.

Every byte goes that lies in a string of ``LENGTH`` bytes which also starts earlier: in a document of smaller
``doc_id``, or before in the same one. All strings are judged on the input.

Only some suffixes have to be sorted. Of the ``LENGTH - GRAM + 1`` grams in a string the one of smallest hash (ties: the
leftmost) is its anchor, so equal strings have equal anchors at equal offsets, and the strings around an anchor,
one next to the other, make a neighbourhood of less than twice ``LENGTH`` bytes. Anchors are counted over all
documents by their grams' hashes, before and after the shuffle; a gram that occurs once has no repeated string.
Neighbourhoods that recur whole are counted too, and only the first of each goes on: every later one is
removed whole. What remains are grams with several neighbourhoods, as at the ends of repeated passages.

Those are sorted. In a task the suffixes that start at the anchors are put in order by a mergesort that compares two of
them through their longest common extension, found by binary search over prefix hashes (polynomials modulo
2**64), so a comparison costs the logarithm of a length. What stands before the anchors is sorted in the same way
backwards. The order and the common extensions of neighbours are then checked byte by byte, and another base is
taken if a hash was wrong. Two strings at the same offset are equal if no shorter extension lies between them in
either order, so each offset needs one grouping of pairs of numbers, and all but the first of a group are removed.

A gram may stand in any share of all documents with other words around it. Groups of over ``MAX_GROUP``
neighbourhoods are therefore divided: offsets are halved, and what all strings of one half have in common, which
is longer than the gram, makes new groups, until groups fit or are one string.

Long texts are worked through in pieces of ``PIECE`` bytes that overlap. Texts are shuffled twice, to have
neighbourhoods and removals cut out of them; otherwise hashes and places move. Stages are tables in the shared folder.

Defined results: a null text has no bytes and stays null, an empty or short one is kept; a null ``doc_id`` comes
after all others; rows of one ``doc_id`` (or none) and different texts are different documents, in the order of
the texts' hashes; rows of equal ``doc_id`` and text count as one document and are all treated alike; an empty
table gives no rows; further columns pass unchanged, and those named ``spans`` or ``kept`` are replaced.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.types import _parse_datatype_string as parse_type

from cohortscope.llm.base import query, rebatched, table, written

LENGTH = 100
GRAM = 32
#: Texts hashed at a time, and pieces of longer ones.
PIECE = 900_000
#: Neighbourhoods sorted at a time, and the largest group that is not divided.
SORTED = 16_384
MAX_GROUP = 16_384
#: Odd bases of the polynomials, and a multiplier that spreads bits.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
SPREAD = np.uint64(0xD6E8FEB86659FD93)
#: Low bits that hold a place while anchors are chosen.
PLACE_BITS = np.uint64(24)
LAST = (1 << 63) - 1
ANCHORS = "key long, u long, id long, t long, at long, m int, left int"
ENTRIES = "key long, low int, high int, id long, t long, at long, m int, left int, bytes binary"
RANGES = "id long, t long, start long, stop long"
SPANS = "array<struct<start:bigint,stop:bigint>>"


def spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * SPREAD
    return x ^ (x >> np.uint64(29))


@functools.lru_cache(maxsize=6)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base`` to the powers below n modulo 2**64, and the inverses."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


class Hashes:
    """Polynomial hashes of all stretches of some bytes."""

    def __init__(self, data: np.ndarray, base: int):
        size = 1 << max(10, int(len(data) - 1).bit_length())
        up, self.down = _powers(base, size)
        terms = up[: len(data)] * (data.astype(np.uint64) + np.uint64(1))
        self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return (self.prefix[start + length] - self.prefix[start]) * self.down[start]

    def grams(self, length: int) -> np.ndarray:
        """Of every stretch of one length."""
        return (self.prefix[length:] - self.prefix[:-length]) * self.down[: len(self.prefix) - length]


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while 2 * done <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    rest = width - done
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def find_anchors(data: np.ndarray, ends: np.ndarray, length: int, gram: int):
    """Anchors of concatenated pieces: key, neighbourhood hash, first string's place, strings, offset in it.

    ``ends`` has, for every byte, where its piece ends; no string crosses that.
    """
    n = len(data) - length + 1
    if n <= 0:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    one, two = Hashes(data, BASES[0]), Hashes(data, BASES[1])
    keys = spread(one.grams(gram))
    mask = (np.uint64(1) << PLACE_BITS) - np.uint64(1)
    placed = (keys & ~mask) | np.arange(len(keys), dtype=np.uint64)
    anchor = (sliding_minimum(placed, length - gram + 1) & mask).astype(np.int64)
    strings = np.flatnonzero(np.arange(n) + length <= ends[:n])
    anchor = anchor[strings]
    fresh = np.ones(len(strings), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (strings[1:] != strings[:-1] + 1)
    first = np.flatnonzero(fresh)
    m = np.diff(np.append(first, len(strings)))
    at, anchor = strings[first], anchor[first]
    left, size = anchor - at, m - 1 + length
    shape = (left * 2 * length + m).astype(np.uint64)
    u = spread(one.of(at, size) + shape) ^ (spread(two.of(at, size)) * SPREAD)
    return keys[anchor], u, at, m, left


def _anchors(length: int, gram: int):
    def hashed(group: list) -> Iterator[pa.RecordBatch]:
        data = np.frombuffer(b"".join(p for *_, p in group), np.uint8)
        sizes = np.array([len(p) for *_, p in group], np.int64)
        stops = np.cumsum(sizes)
        key, u, at, m, left = find_anchors(data, np.repeat(stops, sizes), length, gram)
        piece = np.searchsorted(stops, at, side="right")
        ids, ts, bases = (np.array([p[i] for p in group], np.int64) for i in range(3))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(key.view(np.int64)),
                pa.array(u.view(np.int64)),
                pa.array(ids[piece]),
                pa.array(ts[piece]),
                pa.array(at - (stops - sizes)[piece] + bases[piece]),
                pa.array(m.astype(np.int32)),
                pa.array(left.astype(np.int32)),
            ],
            names=["key", "u", "id", "t", "at", "m", "left"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches, "text", PIECE):
            group, total = [], 0
            for id_, t, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                for base in range(0, len(raw) - length + 1, PIECE):
                    piece = raw[base : base + PIECE + length - 1]
                    if group and total + len(piece) > 2 * PIECE:
                        yield from hashed(group)
                        group, total = [], 0
                    group.append((id_, t, base, piece))
                    total += len(piece)
            if group:
                yield from hashed(group)

    return run


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """id (doc_id, null as the last one) and t (a hash of the text), which tell documents apart."""
    return [F.coalesce(doc_id.cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(text).alias("t")]


class Strings:
    """Stretches of some bytes, ordered and compared by hashes."""

    def __init__(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, base: int):
        self.data, self.start, self.size, self.hashes = data, start, size, Hashes(data, base)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Lengths of common extensions, by binary search over prefix hashes."""
        a, b = self.start[i], self.start[j]
        low, high = np.zeros(len(i), np.int64), np.minimum(self.size[i], self.size[j])
        for _ in range(int(high.max(initial=0)).bit_length()):
            mid = (low + high + 1) // 2
            same = self.hashes.of(a, mid) == self.hashes.of(b, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def less(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        n = self.common(i, j)
        over_i, over_j = n >= self.size[i], n >= self.size[j]
        end = len(self.data) - 1
        a = self.data[np.minimum(self.start[i] + n, end)]
        b = self.data[np.minimum(self.start[j] + n, end)]
        return np.where(over_i | over_j, over_i & ~over_j, a < b)

    def merge_sorted(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The strings in order within their groups; ``begin`` and ``end`` bound each one's group."""
        order, slots, width = np.arange(len(begin)), np.arange(len(begin)), 1
        while True:
            active = slots[end - begin > width]
            if not len(active):
                return order
            lo, hi = begin[active], end[active]
            local = active - lo
            pair = lo + local // (2 * width) * (2 * width)
            second = local // width % 2 == 1
            bottom = np.minimum(np.where(second, pair, pair + width), hi)
            top = np.minimum(bottom + width, hi)
            mine, begin_other = order[active], bottom.copy()
            while True:
                open_ = np.flatnonzero(bottom < top)
                if not len(open_):
                    break
                mid = (bottom[open_] + top[open_]) // 2
                other, own, late = order[mid], mine[open_], second[open_]
                # Of equal strings those of the first run come first.
                before = np.where(late, ~self.less(own, other), self.less(other, own)) if late.any() else self.less(other, own)
                bottom[open_] = np.where(before, mid + 1, bottom[open_])
                top[open_] = np.where(before, top[open_], mid)
            to = pair + (local - second * width) % (2 * width) - (pair - lo) % (2 * width) + (bottom - begin_other)
            order[to] = mine
            width *= 2


def exact_order(data: np.ndarray, start: np.ndarray, size: np.ndarray, begin: np.ndarray, end: np.ndarray):
    """The order within groups, and how much each string shares with the one before it (-1: a group begins).

    Orders found by hashes are checked on the bytes.
    """
    n, width = len(start), int(size.max(initial=0))
    padded = np.concatenate([data, np.zeros(width + 1, np.uint8)])
    first = np.zeros(n, bool)
    first[begin] = True

    def checked(order: np.ndarray) -> np.ndarray | None:
        shared = np.full(n, -1, np.int64)
        later = np.flatnonzero(~first)
        for low in range(0, len(later), 1 << 14):
            part = later[low : low + (1 << 14)]
            a, b = order[part - 1], order[part]
            columns = np.arange(width + 1)
            left, right = (
                np.where(columns < size[x][:, None], padded[start[x][:, None] + columns].astype(np.int16) + 1, 0) for x in (a, b)
            )
            same = left == right
            same[:, -1] = False
            at = same.argmin(axis=1)
            rows = np.arange(len(part))
            if (left[rows, at] > right[rows, at]).any():
                return None
            shared[part] = np.minimum(at, np.minimum(size[a], size[b]))
        return shared

    for base in BASES:
        order = Strings(data, start, size, base).merge_sorted(begin, end)
        shared = checked(order)
        if shared is not None:
            return order, shared
    raw = data.tobytes()
    order = np.array(sorted(range(n), key=lambda i: (begin[i], raw[start[i] : start[i] + size[i]])), np.int64)
    return order, checked(order)


def covered_strings(texts: list[bytes], group: np.ndarray, place: np.ndarray, left: np.ndarray, lowest: np.ndarray, highest: np.ndarray, length: int):
    """Which strings of neighbourhoods occur earlier in their group: rows (neighbourhood, offset of the anchor).

    ``group`` ascends, ``place`` orders the anchors, ``left`` is where in its text each anchor stands. The
    strings of a neighbourhood are those in which the anchor has an offset from ``lowest`` to ``highest``.
    """
    n = len(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    stops = np.cumsum(sizes)
    data = np.frombuffer(b"".join(texts), np.uint8)
    at = stops - sizes + left
    begins = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    counts = np.diff(np.append(begins, n))
    begin, end = np.repeat(begins, counts), np.repeat(begins + counts, counts)
    after, shared_after = exact_order(data, at, stops - at, begin, end)
    before, shared_before = exact_order(data[::-1].copy(), len(data) - at, left, begin, end)
    found = np.zeros((n, length), bool)
    class_after, class_before = np.empty(n, np.int64), np.empty(n, np.int64)
    for offset in range(int(lowest.min()), int(highest.max()) + 1):
        some = np.flatnonzero((lowest <= offset) & (offset <= highest))
        if len(some) < 2:
            continue
        class_after[after] = np.cumsum(shared_after < length - offset)
        class_before[before] = np.cumsum(shared_before < offset)
        alike = class_after[some] * (n + 1) + class_before[some]
        order = np.lexsort((place[some], alike))
        alike, some = alike[order], some[order]
        fresh = np.concatenate([[True], alike[1:] != alike[:-1]])
        first = place[some][np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        found[some, offset] = place[some] > first
    return found


def _covered_ranges(length: int):
    def sort(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key, low, high, ids, ts, at, m, left = (rows.column(i).to_numpy() for i in range(8))
        at, m, left = at.astype(np.int64), m.astype(np.int64), left.astype(np.int64)
        anchor = at + left
        order = np.lexsort((anchor, ts, ids))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (np.diff(ids[order]) != 0) | (np.diff(ts[order]) != 0) | (np.diff(anchor[order]) != 0)
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(fresh)
        found = covered_strings(
            rows.column("bytes").to_pylist(), key, place, left, np.maximum(low, left - m + 1), np.minimum(high, left), length
        )
        edge = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        entry, least = np.nonzero(edge == 1)
        most = np.nonzero(edge == -1)[1] - 1
        starts, stops = anchor[entry] - most, anchor[entry] - least + length
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[entry], ts[entry], starts, stops)], names=["id", "t", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches come by key; rows are held until a group ends, then sorted with those before."""
        held, total = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            total += batch.num_rows
            while total >= SORTED:
                rows = pa.Table.from_batches(held).combine_chunks()
                key = rows.column("key").to_numpy()
                # All groups but the last, which may go on in the next batch.
                last = int(np.searchsorted(key, key[-1]))
                if last == 0:
                    held = rows.to_batches()
                    break
                yield from sort(rows.slice(0, last))
                held, total = rows.slice(last).to_batches(), len(key) - last
        if held:
            yield from sort(pa.Table.from_batches(held).combine_chunks())

    return run


def _cut_out(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, id_, t, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                for x in found:
                    at, m = x["at"], x["m"]
                    out.append((x["key"], 0, length - gram, id_, t, at, m, x["left"], raw[at : at + m - 1 + length]))
            columns = list(zip(*out, strict=True)) if out else [()] * 9
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            names = ["key", "low", "high", "id", "t", "at", "m", "left", "bytes"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


def divided(entries: DataFrame, length: int) -> DataFrame:
    """The entries by either half of their offsets, with what all strings of that half share as their key.

    Strings whose anchors have offsets from l to h share the bytes from l before the anchor to length - h behind it,
    which a neighbourhood with any such string has.
    """
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    halves = F.array(
        F.struct(F.col("low").alias("l"), middle.alias("h")), F.struct((middle + 1).alias("l"), F.col("high").alias("h"))
    )
    l, h, left = F.col("half.l"), F.col("half.h"), F.col("left")
    shared = F.substring("bytes", left - l + 1, F.lit(length) - h + l)
    parts = entries.withColumn("half", F.explode(halves)).filter((l <= left) & (h >= left - F.col("m") + 1))
    return parts.select(
        F.xxhash64("key", l, shared).alias("key"), l.alias("low"), h.alias("high"), "id", "t", "at", "m", "left", "bytes"
    )


def _equal_strings(entries: DataFrame, length: int) -> DataFrame:
    """Ranges of all but the first of equal strings, for entries of a single offset."""
    start = F.col("at") + F.col("left") - F.col("low")
    strings = entries.select(
        F.substring("bytes", F.col("left") - F.col("low") + 1, F.lit(length)).alias("string"), "id", "t", start.alias("start")
    )
    place = F.struct("id", "t", "start")
    first = written(strings.groupBy("string").agg(F.min(place).alias("first")), "first-strings")
    later = strings.join(first, "string").filter(place > F.col("first"))
    return later.select("id", "t", "start", (F.col("start") + length).alias("stop"))


def _sorted_ranges(entries: DataFrame, length: int, max_group: int) -> DataFrame:
    """id, t, start, stop of the strings in ``entries`` that occur before, by sorting groups that fit."""
    found = []
    while True:
        large = entries.groupBy("key").count().filter(F.col("count") > max_group).select("key")
        large = written(large, "large-groups")
        none = large.isEmpty()
        small = entries if none else entries.join(large, "key", "left_anti")
        by_key = small.repartition("key").sortWithinPartitions("key")
        found.append(by_key.mapInArrow(_covered_ranges(length), RANGES))
        if none:
            break
        rest = entries.join(large, "key", "left_semi")
        single = F.col("low") == F.col("high")
        found.append(_equal_strings(rest.filter(single), length))
        entries = written(divided(rest.filter(~single), length), "neighbourhoods")
    return functools.reduce(DataFrame.union, found)


def repeated_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, max_group: int = MAX_GROUP) -> DataFrame:
    """id, t (see ``row_key``), start, stop of bytes in strings of ``length`` bytes that start earlier, too."""
    text = F.col("text").cast("string")
    rows = docs.select(*row_key(F.col("doc_id"), text), text.alias("text")).filter(F.octet_length("text") >= length)
    anchors = rows.mapInArrow(_anchors(length, gram), ANCHORS)
    counted = anchors.groupBy("key").agg(F.count("*").alias("n"), F.min("u").alias("a"), F.max("u").alias("z"))
    recurring = written(counted.filter("n > 1").select("key", (F.col("a") != F.col("z")).alias("mixed")), "grams")
    found = written(anchors.join(recurring, "key"), "anchors")
    place = F.struct("id", "t", "at")
    first = found.groupBy("key", "u").agg(
        F.min(place).alias("first"), F.min("m").alias("m"), F.min("left").alias("left"), F.max("mixed").alias("mixed")
    )
    first = written(first, "first-neighbourhoods")
    whole = found.join(first.select("key", "u", "first"), ["key", "u"]).filter(place > F.col("first"))
    whole = whole.select("id", "t", F.col("at").alias("start"), (F.col("at") + F.col("m") - 1 + length).alias("stop"))
    wanted = (
        first.filter("mixed")
        .select("first.id", "first.t", F.struct("key", "first.at", "m", "left").alias("one"))
        .groupBy("id", "t")
        .agg(F.collect_list("one").alias("found"))
    )
    cut = rows.join(wanted, ["id", "t"]).select("text", "id", "t", "found").mapInArrow(_cut_out(length, gram), ENTRIES)
    return whole.union(_sorted_ranges(written(cut, "neighbourhoods"), length, max_group))


def _remove(text_at: int, ranges_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, kept = [], []
            for text, ranges in zip(batch.column(text_at).to_pylist(), batch.column(ranges_at).to_pylist(), strict=True):
                raw = None if text is None else text.encode("utf-8", "surrogatepass")
                merged: list[list[int]] = []
                for start, stop in sorted((r["start"], r["stop"]) for r in ranges or ()):
                    if merged and start <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], stop)
                    else:
                        merged.append([start, stop])
                if merged:
                    edges = [0, *(x for span in merged for x in span), len(raw)]
                    raw = b"".join(raw[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True))
                spans.append([{"start": a, "stop": z} for a, z in merged])
                kept.append(raw)
            columns = [c for i, c in enumerate(batch.columns) if i != ranges_at]
            names = [n for i, n in enumerate(batch.schema.names) if i != ranges_at]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            columns += [pa.array(spans, kind), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "spans", "kept"])

    return run


def remove_repeated_strings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, max_group: int = MAX_GROUP) -> DataFrame:
    """``docs`` (doc_id, text, ...) with ``spans``, the removed stretches of bytes, and ``kept``, the bytes left."""
    base = docs.select(*[c for c in docs.columns if c not in ("spans", "kept")])
    base = base.withColumn("text", F.col("text").cast("string"))
    ranges = repeated_ranges(base, length, gram, max_group)
    ranges = ranges.groupBy("id", "t").agg(F.collect_set(F.struct("start", "stop")).alias("ranges"))
    # Positional names keep clear of whatever the input's columns are called.
    inner = base.toDF(*[f"c{i}" for i in range(len(base.columns))])
    doc_id, text = (inner[f"c{base.columns.index(c)}"] for c in ("doc_id", "text"))
    same = [own == ranges[c] for own, c in zip(row_key(doc_id, text), ("id", "t"), strict=True)]
    joined = inner.join(ranges, same, "left").drop("id", "t")
    plain = StructType([*inner.schema.fields, *parse_type(f"spans {SPANS}, kept binary").fields])
    removed = joined.mapInArrow(_remove(base.columns.index("text"), len(base.columns)), plain)
    return removed.toDF(*base.columns, "spans", "kept")


@query("op12_suffix_dedup")
def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and stretches removed of every document, and a digest of what is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.stop - s.start)
    return remove_repeated_strings(docs).select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        gone.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2(F.coalesce("kept", F.lit("").cast("binary")), 256).alias("kept_sha256"),
    )
