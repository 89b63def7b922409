"""Packing token streams into fixed windows with a controlled mixture of sources.

Every source is a queue of its documents' tokens. Windows are filled in rounds of deficit round-robin: in
each round a queue earns its share of one window, is served in whole chunks of ``chunk`` tokens as far as
its deficit reaches, and keeps the rest of the deficit for later rounds. A queue that runs out leaves its
share to the others. What the rounds serve is laid end to end and cut every ``window`` tokens, so only the
very last sequence can fall short, and a source's tokens up to any round stay within one chunk of its
target.

The state of the rounds is a function of the round alone: with virtual time ``v`` chosen so that the
queues have earned ``window`` tokens per round together, queue j has earned ``min(T_j, weight_j * v)`` and
has been served the whole chunks in it. So every task computes for its own documents in which round and
where each chunk lies, from the tokens that stand before them in their queue; deficits carry across windows,
tasks and partitions without any task seeing the others' rows. Documents queue in the order of the
tokenised table's parts and, within a part, of its rows.

By default the targets are the sources' shares of all tokens, with which every queue lasts to the end. Other
weights (``targets``) hold until queues run out.

Defined results: a null text is an empty text and holds the end id alone; null is a source of its own; a
null ``doc_id`` and repeated rows are packed like others; an empty table gives no rows; other columns are
not read. More than ``MAX_SOURCES`` sources raise an error, as the schedule is known to every task.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortscope.llm.base import query, rebatched, table, written
from cohortscope.llm.token_files import END_ID, with_end
from cohortscope.llm.tokens import SLICE, encoder, vocabulary

WINDOW = 4096
CHUNK = 64
MAX_SOURCES = 100_000
#: Rounds and queues looked at together, which bounds a task's memory for any number of sources.
ROUNDS = 1024
QUEUES = 1024
TOKENS_SCHEMA = "doc_id long, source string, part int, before long, doc_tokens long, ids binary"
PIECES_SCHEMA = (
    "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, "
    "source string, ids binary"
)


@dataclass
class Schedule:
    """How many tokens of each queue the rounds have served."""

    totals: np.ndarray
    weights: np.ndarray
    window: int = WINDOW
    chunk: int = CHUNK

    def __post_init__(self) -> None:
        self.tokens = int(self.totals.sum())
        self.rounds = -(-self.tokens // self.window)
        # What all have earned: the totals of the queues that ran out, and the weights of the others.
        order = np.argsort(self.totals / self.weights, kind="stable")
        ends = (self.totals / self.weights)[order]
        self.times = np.concatenate([[0.0], np.unique(ends)])
        out = np.searchsorted(ends, self.times, side="right")
        held = np.concatenate([[0], np.cumsum(self.totals[order])])[out]
        left = np.concatenate([np.cumsum(self.weights[order][::-1])[::-1], [0.0]])[out]
        self.earned = np.maximum.accumulate(held + left * self.times)
        # Queues start at different points of a chunk, so that they aren't all served in the same rounds.
        self.phase = (np.arange(1, len(self.totals) + 1) * 0.6180339887498949) % 1.0

    def served(self, queue: np.ndarray, rounds: np.ndarray) -> np.ndarray:
        """Tokens of ``queue`` served before round ``rounds`` (arrays that broadcast)."""
        time = np.interp(rounds * float(self.window), self.earned, self.times)
        chunks = np.floor(self.weights[queue] * time / self.chunk + self.phase[queue]).astype(np.int64)
        part = np.minimum(chunks * self.chunk, self.totals[queue])
        return np.where(rounds <= 0, 0, np.where(rounds >= self.rounds, self.totals[queue], part))

    def round_of(self, queue: int, token: np.ndarray) -> np.ndarray:
        """The round that serves each token of a queue."""
        ends = np.minimum((token // self.chunk + 1) * self.chunk, self.totals[queue])
        time = (ends / self.chunk - self.phase[queue]) * self.chunk / self.weights[queue]
        found = np.ceil(np.interp(time, self.times, self.earned) / self.window).astype(np.int64)
        found = np.clip(found, 1, self.rounds)
        while (late := (found > 1) & (self.served(queue, found - 1) >= ends)).any():
            found = found - late
        while (early := self.served(queue, found) < ends).any():
            found = found + early
        return found - 1

    def place(self, queue: int, token: np.ndarray) -> np.ndarray:
        """The position in the packed stream of tokens that begin a chunk or lie in it."""
        at = self.round_of(queue, token)
        different, back = np.unique(at, return_inverse=True)
        begin = np.zeros(len(different), np.int64)
        for a in range(0, len(different), ROUNDS):
            piece = different[a : a + ROUNDS][None, :]
            for b in range(0, len(self.totals), QUEUES):
                some = np.arange(b, min(b + QUEUES, len(self.totals)))[:, None]
                # Queues before this one are served in the round first, the others after it.
                begin[a : a + ROUNDS] += self.served(some, piece + (some < queue)).sum(axis=0)
        return begin[back] + token - self.served(queue, at)


def cut(schedule: Schedule, queue: int, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pieces of documents that stand at ``begins`` in a queue: document, start, length and place."""
    chunk, window = schedule.chunk, schedule.window
    first, last = begins // chunk, (begins + sizes - 1) // chunk
    n = last - first + 1
    doc = np.repeat(np.arange(len(begins)), n)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + first[doc]
    a = np.maximum(number * chunk, begins[doc])
    z = np.minimum((number + 1) * chunk, (begins + sizes)[doc])
    at = schedule.place(queue, a)
    # A chunk that crosses the end of a sequence is two pieces.
    room = window - at % window
    over = z - a > room
    doc = np.concatenate([doc, doc[over]])
    at = np.concatenate([at, (at + room)[over]])
    a, z = np.concatenate([a, (a + room)[over]]), np.concatenate([np.where(over, a + room, z), z[over]])
    order = np.lexsort((a, doc))
    doc, a, z, at = doc[order], a[order], z[order], at[order]
    # Neighbours that stay neighbours within a sequence are one piece.
    joined = (doc[1:] == doc[:-1]) & (at[1:] == at[:-1] + z[:-1] - a[:-1]) & (at[1:] % window != 0)
    heads = np.flatnonzero(np.concatenate([[True], ~joined]))
    tails = np.concatenate([heads[1:], [len(doc)]]) - 1
    return doc[heads], a[heads] - begins[doc[heads]], z[tails] - a[heads], at[heads]


def _tokenise(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, queued = encoder(path).encode, TaskContext.get().partitionId(), {}
        for batch in rebatched(batches, "text", SLICE):
            ids, offsets = with_end(*encode(batch.column("text")), end_id)
            sizes, before = np.diff(offsets).tolist(), []
            for source, n in zip(batch.column("source").to_pylist(), sizes, strict=True):
                before.append(queued.get(source, 0))
                queued[source] = before[-1] + n
            raw, width, cuts = ids.tobytes(), ids.dtype.itemsize, offsets.tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("source"),
                    pa.array([part] * len(sizes), pa.int32()),
                    pa.array(before, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array([raw[a * width : z * width] for a, z in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                ],
                names=["doc_id", "source", "part", "before", "doc_tokens", "ids"],
            )

    return run


def _pack(schedule: Schedule, queues: dict, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches, "ids", 4_000_000):
            sources = batch.column("source").to_pylist()
            queue = np.array([queues[s] for s in sources], np.int64)
            begins = batch.column("begin").to_numpy(zero_copy_only=False)
            sizes = batch.column("doc_tokens").to_numpy(zero_copy_only=False)
            held = [np.frombuffer(b.as_buffer(), dtype) for b in batch.column("ids")]
            ids, starts = np.concatenate(held).astype("<u4"), np.cumsum(sizes) - sizes
            docs, parts = [], []
            for q in np.unique(queue).tolist():
                own = np.flatnonzero(queue == q)
                doc, *rest = cut(schedule, q, begins[own], sizes[own])
                docs.append(own[doc])
                parts.append(rest)
            doc = np.concatenate(docs)
            start, length, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            raw, first = ids.tobytes(), (starts[doc] + start).tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(doc)),
                    pa.array(start),
                    pa.array(length),
                    pa.array(sizes[doc]),
                    pa.array(at // schedule.window),
                    pa.array(at % schedule.window),
                    batch.column("source").take(pa.array(doc)),
                    pa.array([raw[4 * a : 4 * (a + n)] for a, n in zip(first, length.tolist(), strict=True)], pa.binary()),
                ],
                names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "source", "ids"],
            )

    return run


def pack(
    docs: DataFrame,
    vocabulary_path: str,
    targets: Mapping[str | None, float] | None = None,
    window: int = WINDOW,
    chunk: int = CHUNK,
    end_id: int = END_ID,
) -> DataFrame:
    """Pieces of all ``docs`` (doc_id, source, text): where each lies, and its ids as 32-bit numbers.

    Texts are encoded where they are read and don't move. The tokenised table lies in the shared folder;
    its parts' totals per source, which are small, are joined back to it.
    """
    spark = docs.sparkSession
    columns = [F.col(c).cast(t).alias(c) for c, t in (("doc_id", "long"), ("source", "string"), ("text", "string"))]
    tokens = written(
        docs.select(*columns).mapInArrow(_tokenise(vocabulary_path, end_id), TOKENS_SCHEMA), "tokenised", compression="zstd"
    )
    totals = written(tokens.groupBy("part", "source").agg(F.sum("doc_tokens").alias("n")), "token-totals")
    queues = totals.groupBy("source").agg(F.sum("n").alias("n")).orderBy("source").limit(MAX_SOURCES + 1).collect()
    if len(queues) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    if not queues:
        return spark.createDataFrame([], PIECES_SCHEMA)
    counts = np.array([q.n for q in queues], np.int64)
    weights = counts / counts.sum() if targets is None else np.array([float(targets.get(q.source, 0)) for q in queues])
    if (weights <= 0).any():
        raise ValueError("every source needs a target above 0")
    schedule = Schedule(counts, weights, window, chunk)
    numbers = {q.source: i for i, q in enumerate(queues)}
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("part").alias("p"), F.col("source").alias("s"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("o")
    )
    placed = tokens.join(offsets, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "source", (F.col("before") + F.col("o")).alias("begin"), "doc_tokens", "ids"
    )
    return placed.mapInArrow(_pack(schedule, numbers, encoder(vocabulary_path).dtype.str), PIECES_SCHEMA)


def pieces(docs: DataFrame) -> DataFrame:
    """Packed pieces with the checksum of their ids instead of the ids."""
    packed = pack(docs, vocabulary("word_bpe_49k.json"))
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source"
    )


@query("op9_packing")
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens with each source's share of every sequence."""
    return pieces(table(spark, sf_dir, "documents"))
