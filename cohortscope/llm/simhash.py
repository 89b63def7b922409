"""Near duplicates by SimHash: fingerprints at most a few bits apart are linked, and links chained.

Fingerprints of 64 bits are eight bytes. Two of them that differ in at most ``bits`` <= 3 bits differ in
at most three bytes, so they share at least five bytes in the same positions: the guaranteed minimum.
The inverted index lists fingerprints under bytes with their positions. Of five shared positions, three
always lie in the same half of the eight, so that it is enough to index the eight triples of positions
within a half. Fingerprints that meet under a triple have their shared positional bytes tallied, pairs
with fewer than five are let go, and the rest are verified by counting differing bits.

A list under one triple has all fingerprints of the corpus with these 24 bits. Lists longer than
``MAX_LIST`` are split by two further bytes, for each of the ten ways to choose them, which again loses
no pair that shares five. What is still long then agrees in 40 bits; it holds at most 2**24 different
fingerprints, is searched outwards from one fingerprint to all within reach, and gives a chain of links
instead of all pairs. So no list is cut and no group emits the square of its size.

Only different fingerprints are indexed: copies have collapsed before. Everything else moves eight-byte
numbers.

Defined results: a text that is null, empty or white space has no words and fingerprint zero, and is
linked like any other; fewer words than the shingle length make one shingle; the component of documents
is their smallest ``doc_id``, null only where no document in it has one; repeated rows are kept, a row
each; an empty table gives no rows; other columns are not read (``fingerprints`` keeps none of them).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortscope.llm.base import query, rebatched, table, written
from cohortscope.llm.components import connected_components
from cohortscope.operators.skew import join_aggregated

SEED = 42
SHINGLE = 3
BITS = 3
MAX_LIST = 512
TRIPLES = [*itertools.combinations(range(4), 3), *itertools.combinations(range(4, 8), 3)]
#: Shingles hashed at a time, which bounds the memory that a very long text takes.
BLOCK = 1 << 18


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of one text."""
    import xxhash

    words = [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    first, last = begins[: len(words) - shingle + 1], ends[shingle - 1 :]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(first), BLOCK):
        spans = zip(first[at : at + BLOCK].tolist(), last[at : at + BLOCK].tolist(), strict=True)
        hashes = np.array([digest(joined[a:z], SEED) for a, z in spans], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64
        )
    return int(np.packbits(ones * 2 > len(first), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches, "text"):
            prints = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "fp"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _byte(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * position).bitwiseAND(F.lit(255))


def _masked(fp: Column, positions: tuple[int, ...]) -> Column:
    mask = sum(255 << (8 * p) for p in positions)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def _indexed(nodes: DataFrame, position_sets: list[tuple[int, ...]]) -> DataFrame:
    """fp under every one of its lists: the positions' number and the bytes there."""
    lists = [
        F.struct(F.lit(i).alias("positions"), _masked(F.col("fp"), p).alias("bytes"))
        for i, p in enumerate(position_sets)
    ]
    return nodes.select("fp", F.explode(F.array(*lists)).alias("l")).select("fp", "l.positions", "l.bytes")


def _sized(lists: DataFrame, label: str) -> DataFrame:
    """Lists of two and more with their length, kept in the shared folder."""
    keys = ["positions", "bytes"]
    sizes = lists.groupBy(*keys).agg(F.count("*").alias("length")).filter("length > 1")
    return written(join_aggregated(lists, sizes, keys), label)


def _tallied_pairs(lists: DataFrame, bits: int) -> DataFrame:
    """Verified pairs within the lists: shared positional bytes first, differing bits after."""
    a = lists.select("positions", "bytes", F.col("fp").alias("a"))
    b = lists.select("positions", "bytes", F.col("fp").alias("b"))
    difference = F.col("a").bitwiseXOR(F.col("b"))
    shared = sum((_byte(difference, i) == 0).cast("int") for i in range(8))
    return (
        a.join(b, ["positions", "bytes"])
        .filter((F.col("a") < F.col("b")) & (shared >= 8 - bits) & (F.bit_count(difference) <= bits))
        .select("a", "b")
    )


def _reach(group: pa.Table, bits: int) -> pa.Table:
    """Links that connect a long list just as all its pairs would: each fingerprint to its finder."""
    left = np.unique(group.column("fp").to_numpy())
    found, by = [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count((left ^ at).view(np.uint64)) <= bits
            if near.any():
                reached = left[near]
                found.append(reached)
                by.append(np.full(len(reached), at))
                queue.extend(reached.tolist())
                left = left[~near]
    empty = np.zeros(0, np.int64)
    return pa.table({"a": np.concatenate([empty, *by]), "b": np.concatenate([empty, *found])})


def fingerprint_links(nodes: DataFrame, bits: int = BITS, max_list: int = MAX_LIST) -> DataFrame:
    """Pairs (a, b) of different fingerprints that connect whatever ``bits`` differing bits connect.

    Every pair in a list up to ``max_list``, and a chain through each longer one.
    """
    if not 0 <= bits <= 3:
        raise ValueError("the index guarantees pairs up to three differing bits")
    by_three = _sized(_indexed(nodes, TRIPLES), "lists-of-three")
    short = _tallied_pairs(by_three.filter(F.col("length") <= max_list), bits)
    rest = [tuple(p for p in range(8) if p not in t) for t in TRIPLES]
    fives = sorted({tuple(sorted(t + two)) for t, r in zip(TRIPLES, rest, strict=True) for two in itertools.combinations(r, 2)})
    long = by_three.filter(F.col("length") > max_list).select("fp").distinct()
    by_five = _sized(_indexed(long, fives), "lists-of-five")
    split = _tallied_pairs(by_five.filter(F.col("length") <= max_list), bits)
    dense = (
        by_five.filter(F.col("length") > max_list)
        .groupBy("positions", "bytes")
        .applyInArrow(lambda group: _reach(group, bits), "a long, b long")
    )
    return short.union(split).union(dense)


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS, max_list: int = MAX_LIST
) -> DataFrame:
    """doc_id, fp and component_id for every row of ``docs`` (doc_id, text)."""
    prints = written(fingerprints(docs, shingle), "fingerprints")
    # The smallest doc_id of each different fingerprint stands for its copies.
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    labels = connected_components(fingerprint_links(nodes.select("fp"), bits, max_list))
    labelled = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp")
    )
    smallest = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"))
    members = join_aggregated(labelled, smallest, ["component"]).select("fp", "component_id")
    return join_aggregated(prints, members, ["fp"]).select("doc_id", "fp", "component_id")


@query("op1_simhash")
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
