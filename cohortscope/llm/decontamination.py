"""Benchmark decontamination by latent semantic retrieval, with exact checks after it.

Benchmark items are cut into passages of at most ``PASSAGE`` words. Passages are TF-IDF vectors over the
benchmark's words, with document frequencies counted over the whole corpus. A randomised singular value
decomposition, run as Spark jobs that sum ``A'(AQ)`` over the passages' partitions, gives the ``RANK``
directions that describe the passages best. Words in more than ``MAX_SHARE`` of all texts get no weight unless
these are few or they are among the rarest of some passage. Windows of every document are folded into that space, and the
cosine to each passage names the candidates, if the window also has ``MIN_WEIGHT`` of the passage's own
weight along its direction. Windows come in three widths, half as long again as the
longest passages they serve and a third of their width apart, so every copy of a passage lies whole in one.

The directions can't describe every one of many passages, and words of the surroundings count in the cosine.
So windows are also looked up by words: whoever has ``MIN_LCS`` of a passage has ``needed`` of its rarest
words, however these are chosen, and every such window is a candidate if the words it shares with the passage
have ``MIN_WEIGHT`` of the passage's squared weight, by all frequencies and without directions. An exact copy
is therefore found whatever the number of passages, its surroundings and its share of the corpus.

A candidate is a leak if the longest common subsequence of words covers ``MIN_LCS`` of the passage (which
lets words be changed, added or left out) and the answer is there too: the item's answer, if the benchmark
has a column of that name, or else half of the words in the last ``1 / LAST`` of the passage. Passages of fewer than
``SHORT`` words must occur word for word.

The benchmark is worked through in blocks of about ``MAX_PASSAGES`` passages, so what tasks receive is
bounded: at most ``PASSAGE * MAX_PASSAGES`` words with ``RANK`` numbers each. Documents never move.

Defined results: null, empty and wordless texts, of documents or items, leak nothing; repeated items are
reported once each; repeated documents each have their leaks; an empty corpus or benchmark gives no leak;
``find_leaks`` passes all other columns through and replaces one named ``leaks``.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.types import _parse_datatype_string as parse_type

from cohortscope.llm.base import query, rebatched, table

PASSAGE = 64
MAX_PASSAGES = 4096
RANK = 64
OVERSAMPLE = 16
POWER_STEPS = 2
MAX_SHARE = 0.02
MIN_COSINE = 0.55
MIN_WEIGHT = 0.3
MIN_LCS = 0.6
LAST = 4
COMMON = 20
SHORT = 8
BLOCK = 8
#: Longest passage served, blocks in a window, blocks from one window to the next.
SCALES = ((16, 3, 1), (32, 6, 2), (64, 12, 4))
SLICE = 2_000_000
#: Occurrences of passages' rare words that are counted at a time.
LOOKED_UP = 4_000_000
LEAKS = "array<struct<item_id:bigint,passage:int,lcs:double,cosine:double>>"
PASSAGES_SCHEMA = "item_id long, passage int, words array<string>, answer array<string>, spread long"


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of texts, which word stands where, and where each text begins and the last ends.

    Words are what white space separates, in small letters, without the marks around them.
    """
    split = pc.utf8_split_whitespace(pc.utf8_lower(texts.cast(pa.large_string()).fill_null("")))
    flat = split.flatten().dictionary_encode()
    trimmed = pc.utf8_trim(flat.dictionary, characters=string.punctuation).dictionary_encode()
    distinct = trimmed.dictionary
    which = trimmed.indices.to_numpy(zero_copy_only=False)[flat.indices.to_numpy(zero_copy_only=False)]
    bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
    blank = pc.index_in(pa.scalar("", pa.large_string()), value_set=distinct).as_py() if len(distinct) else None
    if blank is not None:
        kept = which != blank
        bounds = np.concatenate([[0], np.cumsum(kept)])[bounds]
        which = which[kept]
    return distinct, which, bounds


def _cut_items(answers: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches, "text", SLICE):
            distinct, which, bounds = words(batch.column("text"))
            names = distinct.to_pylist()
            if answers:
                own, at, ends = words(batch.column("answer"))
                own = own.to_pylist()
            rows = []
            for i, item in enumerate(batch.column("item_id").to_pylist()):
                found = [names[w] for w in which[bounds[i] : bounds[i + 1]]]
                answer = [own[w] for w in at[ends[i] : ends[i + 1]]] if answers else []
                pieces = -(-len(found) // PASSAGE)
                cuts = [len(found) * k // pieces for k in range(pieces + 1)] if pieces else []
                rows += [(item, k, found[a:z], answer) for k, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False))]
            item, number, text, answer = zip(*rows, strict=True) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(item, pa.int64()),
                    pa.array(number, pa.int32()),
                    pa.array(text, pa.list_(pa.string())),
                    pa.array(answer, pa.list_(pa.string())),
                ],
                names=["item_id", "passage", "words", "answer"],
            )

    return run


def passages(benchmark: DataFrame) -> DataFrame:
    """Passages of the items of ``benchmark`` (item_id, text, perhaps answer) with a hash to spread them."""
    answers = "answer" in benchmark.columns
    columns = [F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")]
    if answers:
        columns.append(F.col("answer").cast("string").alias("answer"))
    cut = benchmark.select(*columns).distinct().mapInArrow(
        _cut_items(answers), "item_id long, passage int, words array<string>, answer array<string>"
    )
    return cut.withColumn("spread", F.xxhash64("item_id", "passage", "words"))


def document_frequencies(docs: DataFrame, terms: list[str]) -> tuple[int, np.ndarray]:
    """How many texts there are, and how many hold each term; tasks send at most a number per term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total, counts = pa.array(terms, pa.large_string()), 0, np.zeros(len(terms), np.int64)
        for batch in rebatched(batches, "text", SLICE):
            distinct, which, bounds = words(batch.column("text"))
            term = pc.index_in(distinct, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)[which]
            row = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            pairs = np.unique((row * len(terms) + term)[term >= 0])
            counts += np.bincount(pairs % len(terms), minlength=len(terms))
            total += batch.num_rows
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(held, -1)), pa.array(np.append(counts[held], total))], names=["term", "n"]
        )

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "term long, n long")
    total, counts = 0, np.zeros(len(terms), np.int64)
    for r in rows.groupBy("term").agg(F.sum("n").alias("n")).collect():
        if r.term < 0:
            total = r.n
        else:
            counts[r.term] = r.n
    return total, counts


def right_singular_vectors(rows: DataFrame, size: int, rank: int, seed: int = 0) -> np.ndarray:
    """The leading right singular vectors of a sparse matrix, by a distributed randomised decomposition.

    ``rows`` holds (index array<int>, value array<double>), a matrix row each; ``size`` is the number of
    columns. Each job sends a ``size`` x (rank + OVERSAMPLE) basis out and gets such sums back.
    """
    width = min(size, rank + OVERSAMPLE)
    rows = rows.coalesce(8)

    def multiplied(basis: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros_like(basis)
            for batch in batches:
                for index, value in zip(batch.column("index"), batch.column("value"), strict=True):
                    at, x = index.values.to_numpy(), value.values.to_numpy()
                    total[at] += np.outer(x, x @ basis[at])
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

        parts = rows.mapInArrow(run, "part binary").toLocalIterator()
        return sum((np.frombuffer(p.part).reshape(basis.shape) for p in parts), np.zeros_like(basis))

    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, width)))[0]
    for _ in range(POWER_STEPS):
        basis = np.linalg.qr(multiplied(basis))[0]
    squared, turn = np.linalg.eigh(basis.T @ multiplied(basis))
    order = np.argsort(-squared)[:rank]
    return basis @ turn[:, order[squared[order] > 1e-12 * max(squared.max(), 1e-300)]]


@dataclass
class Block:
    """What tasks need to find leaks of one block of passages."""

    terms: list[str]
    folding: np.ndarray
    item: list[int]
    passage: list[int]
    words: list[np.ndarray]
    answers: list[np.ndarray]
    endings: list[np.ndarray]
    latent: np.ndarray
    weight: np.ndarray
    scale: np.ndarray
    shares: list[np.ndarray]
    needed: np.ndarray
    listed: list[tuple[np.ndarray, np.ndarray]]
    masks: list[dict] = field(default_factory=list)

    def prepare(self) -> None:
        """Bit masks of each passage's words, made where they are used."""
        if not self.masks and self.words:
            for ids in self.words:
                mask = {}
                for i, w in enumerate(ids.tolist()):
                    mask[w] = mask.get(w, 0) | 1 << i
                self.masks.append(mask)


def common_subsequence(mask: dict, length: int, sequence: list[int]) -> int:
    """Length of the longest common subsequence with a passage of ``length`` words, by bit operations."""
    full = (1 << length) - 1
    state = full
    for w in sequence:
        m = mask.get(w)
        if m:
            u = state & m
            state = ((state + u) | (state - u)) & full
    return length - state.bit_count()


def _contains(sequence: np.ndarray, run: np.ndarray) -> bool:
    if len(run) == 0 or len(run) > len(sequence):
        return len(run) == 0
    seen = np.lib.stride_tricks.sliding_window_view(sequence, len(run))
    return bool((seen == run).all(axis=1).any())


def _verified(block: Block, p: int, window: np.ndarray, min_lcs: float) -> float:
    """The share of passage ``p`` that the window has as a subsequence, 0 if it is no leak."""
    run = block.words[p]
    if len(run) < SHORT:
        share = 1.0 if _contains(window, run) else 0.0
    else:
        share = common_subsequence(block.masks[p], len(run), window.tolist()) / len(run)
    if share < min_lcs:
        return 0.0
    if len(block.answers[p]):
        return share if _contains(window, block.answers[p]) else 0.0
    ending = block.endings[p]
    return share if 2 * np.isin(ending, window).sum() >= len(ending) else 0.0


def _looked_up(block: Block, s: int, term: np.ndarray, place: np.ndarray, owner: np.ndarray, begins: np.ndarray):
    """First blocks of windows of one scale, with passages of whose rare words they have ``needed``."""
    _, wide, stride = SCALES[s]
    heads, listed = block.listed[s]
    sizes = np.diff(heads)
    held = np.flatnonzero((term >= 0) & (sizes[term] > 0))
    held = held[np.unique(place[held] * len(sizes) + term[held], return_index=True)[1]]
    found = []
    # Passages are taken a few at a time where the texts have too many of their words.
    n = len(block.words)
    parts = max(1, -(-int(sizes[term[held]].sum()) // LOOKED_UP))
    for part in range(parts):
        if parts > 1:
            chosen = listed % parts == part
            sizes = np.diff(np.concatenate([[0], np.cumsum(chosen)])[heads])
            own, first = listed[chosen], np.cumsum(sizes) - sizes
        else:
            own, first = listed, heads[:-1]
        times = sizes[term[held]]
        ends = np.cumsum(times)
        passage = own[np.repeat(first[term[held]] - (ends - times), times) + np.arange(times.sum())]
        pair, count = np.unique(np.repeat(place[held], times) * n + passage, return_counts=True)
        at, passage = pair // n, pair % n
        inside = at - begins[owner[at]]
        starts = []
        for back in range(wide // stride):
            start = (inside // stride - back) * stride
            starts.append(np.where(start >= 0, at - inside + start, -1))
        starts = np.concatenate(starts)
        lies = starts >= 0
        pair = (starts * n + np.tile(passage, wide // stride))[lies]
        pair, which = np.unique(pair, return_inverse=True)
        total = np.bincount(which, np.tile(count, wide // stride)[lies], len(pair))
        found.append(pair[total >= block.needed[pair % n]])
    pair = np.concatenate(found)
    return pair // n, pair % n


def _search(block: Block, text_at: int, names: list[str], min_cosine: float, min_lcs: float):
    def found_in(texts: pa.Array) -> list[list[dict]]:
        distinct, which, bounds = words(texts)
        known = pa.array(block.terms, pa.large_string())
        term = pc.index_in(distinct, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)[which]
        row = np.repeat(np.arange(len(texts)), np.diff(bounds))
        blocks = -(-np.diff(bounds) // BLOCK)
        block_begins = np.concatenate([[0], np.cumsum(blocks)])
        place = block_begins[row] + (np.arange(len(term)) - bounds[row]) // BLOCK
        weighted = np.flatnonzero((term >= 0) & block.folding.any(axis=1)[term])
        sums = np.zeros((block_begins[-1] + 1, block.folding.shape[1]))
        if len(weighted):
            at = place[weighted]
            heads = np.flatnonzero(np.diff(at, prepend=-1))
            sums[at[heads] + 1] = np.add.reduceat(block.folding[term[weighted]], heads, axis=0)
        np.cumsum(sums, axis=0, out=sums)
        best: list[dict] = [{} for _ in range(len(texts))]
        owner = np.repeat(np.arange(len(texts)), blocks)
        seen = np.zeros(len(block.terms) + 1, bool)
        for s, (_, wide, stride) in enumerate(SCALES):
            served = np.flatnonzero(block.scale == s)
            if not len(served):
                continue
            begin = np.flatnonzero((np.arange(len(owner)) - block_begins[owner]) % stride == 0)
            end = np.minimum(begin + wide, block_begins[owner[begin] + 1])
            latent = (sums[end] - sums[begin]).astype(np.float32)
            norm = np.sqrt(np.einsum("ij,ij->i", latent, latent))
            along = latent @ block.latent[served].T
            near = along >= (min_cosine * np.maximum(norm, 1e-6))[:, None]
            near &= along >= MIN_WEIGHT * np.maximum(block.weight[served], 1e-6)
            w, p = np.nonzero(near)
            start, passage = _looked_up(block, s, term, place, owner, block_begins)
            by_cosine = w * len(block.words) + served[p]
            by_words = np.searchsorted(begin, start) * len(block.words) + passage
            pairs = np.union1d(by_cosine, by_words)
            near = np.isin(pairs, by_cosine)
            for w, p, by in zip(*(x.tolist() for x in (*divmod(pairs, len(block.words)), near)), strict=True):
                doc = int(owner[begin[w]])
                first = bounds[doc] + (begin[w] - block_begins[doc]) * BLOCK
                last = min(bounds[doc + 1], bounds[doc] + (end[w] - block_begins[doc]) * BLOCK)
                window = term[first:last]
                if not by:
                    seen[window] = True
                    seen[-1] = False
                    held = seen[block.words[p]]
                    seen[window] = False
                    if held.sum() < min_lcs * len(held) - 1e-9 or block.shares[p][held].sum() < MIN_WEIGHT:
                        continue
                share = _verified(block, p, window, min_lcs)
                if share > 0:
                    cosine = float(latent[w] @ block.latent[p] / max(norm[w], 1e-6))
                    best[doc][p] = max(best[doc].get(p, (0.0, 0.0)), (share, cosine))
        return [
            [
                {"item_id": block.item[p], "passage": block.passage[p], "lcs": share, "cosine": cosine}
                for p, (share, cosine) in sorted(b.items())
            ]
            for b in best
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block.prepare()
        kind = pa.list_(
            pa.struct([("item_id", pa.int64()), ("passage", pa.int32()), ("lcs", pa.float64()), ("cosine", pa.float64())])
        )
        for batch in rebatched(batches, text_at, SLICE):
            leaks = found_in(batch.column(text_at))
            before = batch.column(batch.num_columns - 1).to_pylist()
            merged = pa.array([a + b for a, b in zip(before, leaks, strict=True)], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], merged], names=names)

    return run


def _rare_words(ids: list[np.ndarray], counts: np.ndarray, min_lcs: float) -> tuple[list[np.ndarray], np.ndarray]:
    """Rare words of each passage, by place, and how many places any window with ``min_lcs`` of it has of them."""
    rare, needed = [], []
    for run in ids:
        least = len(run) if len(run) < SHORT else max(1, int(np.ceil(min_lcs * len(run) - 1e-9)))
        needed.append(max(1, least // 3))
        rare.append(run[np.lexsort((run, counts[run]))][: len(run) - least + needed[-1]])
    return rare, np.array(needed)


def _listed(rare: list[np.ndarray], scale: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each scale where each word's passages begin, and the passages; as often as a word is in them."""
    out = []
    for s in range(len(SCALES)):
        passage = np.concatenate([np.full(len(r), p) for p, r in enumerate(rare) if scale[p] == s] or [np.zeros(0, int)])
        word = np.concatenate([r for p, r in enumerate(rare) if scale[p] == s] or [np.zeros(0, int)])
        out.append((np.searchsorted(np.sort(word), np.arange(size + 1)), passage[np.argsort(word, kind="stable")]))
    return out


def _block(docs: DataFrame, chosen: DataFrame, max_share: float, rank: int, min_lcs: float) -> Block | None:
    rows = chosen.orderBy("item_id", "passage", "spread").collect()
    if not rows:
        return None
    terms = sorted({w for r in rows for w in (*r.words, *r.answer)})
    number = {t: i for i, t in enumerate(terms)}
    ids = [np.array([number[w] for w in r.words], np.int64) for r in rows]
    total, counts = document_frequencies(docs, terms)
    idf = np.log((total + 1) / (counts + 1)) + 1e-3
    used = np.where(counts > max(COMMON, max_share * total), 0.0, idf)
    for run in ids:
        own = np.unique(run)
        rarest = own[np.lexsort((own, counts[own]))][: -(-len(own) // LAST)]
        used[rarest] = idf[rarest]
    vectors, norms, shares = [], [], []
    for run in ids:
        # Words that a passage has n times have a share n * n of its squared weight, n for each place.
        squared = idf[run] ** 2 * (run[:, None] == run).sum(axis=1)
        shares.append(squared / squared.sum())
        index, n = np.unique(run, return_counts=True)
        value = used[index] * n
        norm = np.sqrt((value**2).sum())
        norms.append(norm)
        vectors.append((index.astype(np.int32).tolist(), (value / norm if norm else value).tolist()))
    matrix = docs.sparkSession.createDataFrame(vectors, "index array<int>, value array<double>")
    directions = right_singular_vectors(matrix, len(terms), rank)
    latent = np.stack([np.asarray(v) @ directions[i] for i, v in vectors])
    length = np.sqrt((latent**2).sum(axis=1, keepdims=True))
    scale = np.searchsorted([s[0] for s in SCALES], [len(r) for r in ids])
    rare, needed = _rare_words(ids, counts, min_lcs)
    return Block(
        terms,
        (directions * used[:, None]).astype(np.float32),
        [r.item_id for r in rows],
        [r.passage for r in rows],
        ids,
        [np.array([number[w] for w in r.answer], np.int64) for r in rows],
        [r[-max(1, len(r) // LAST) :] for r in ids],
        (latent / np.maximum(length, 1e-12)).astype(np.float32),
        (length[:, 0] * norms).astype(np.float32),
        scale,
        shares,
        needed,
        _listed(rare, scale, len(terms)),
    )


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    min_cosine: float = MIN_COSINE,
    min_lcs: float = MIN_LCS,
    rank: int = RANK,
    max_share: float = MAX_SHARE,
    max_passages: int = MAX_PASSAGES,
    into: str = "leaks",
) -> DataFrame:
    """``docs`` with a column ``leaks``: the benchmark passages that each text holds, maybe rephrased."""
    base = docs.select(*[c for c in docs.columns if c != into])
    at = base.columns.index("text")
    inner = base.toDF(*[f"c{i}" for i in range(len(base.columns))])
    inner = inner.withColumn(f"c{at}", F.col(f"c{at}").cast("string")).withColumn("leaks", F.expr(f"cast(array() as {LEAKS})"))
    schema = StructType([*inner.schema.fields[:-1], StructField("leaks", parse_type(LEAKS))])
    cut = passages(benchmark)
    n_blocks = max(1, -(-cut.count() // max_passages))
    for b in range(n_blocks):
        block = _block(docs, cut.filter(F.pmod("spread", F.lit(n_blocks)) == b), max_share, rank, min_lcs)
        if block is not None:
            inner = inner.mapInArrow(_search(block, at, schema.names, min_cosine, min_lcs), schema)
    return inner.toDF(*base.columns, into)


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark passage."""
    own = "_".join(["leaks", *docs.columns])
    return find_leaks(docs, benchmark, into=own).filter(F.size(own) == 0).drop(own)


@query("op3_decontamination")
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item in it, with the best share of a passage found."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("leaks").alias("leak"))
    return found.groupBy("doc_id", F.col("leak.item_id").alias("item_id")).agg(
        F.max("leak.lcs").alias("lcs"), F.max("leak.cosine").alias("cosine"), F.count("*").alias("passages")
    )
