"""Spelling variants: words one edit apart, and the much more frequent word that each stands for.

A word's letters are counted in ``DIMS`` classes (code point modulo ``DIMS``, which tells all plain letters apart). One
inserted or deleted letter changes one count by one, a replaced letter at most two, so near words lie within L1
distance one or two. For each length a k-d tree over a bounded sample of the words of that length cuts the space of
counts into boxes of about ``BOX_ROWS`` words. Each word goes to its box of its own length, and asks every box within
distance two in the tree of its length and within distance one in the tree of the next shorter one. In a box the
tree goes on: words are halved along the widest count, questions follow where the halves' bounds are near
enough, and what is left is compared count by count, then letter by letter. A box returns one row a word, the number
of near words and the best of them, never pairs.

A word visits a box for each way in which one or two of the tree's cuts can be crossed, so copies grow with the
square of the tree's depth at most while boxes keep their size. The tree in the tasks has at most two nodes per
sampled word, and the sample decides only where boxes end, so results don't depend on it.

A word's form is its near word of greatest count (ties: the smallest in code-point order) if that is at least ``RATIO``
times as frequent. Forms are followed to the last by doubling steps, a joined table each; counts grow by ``RATIO`` with
every form, so the number of rounds is known from the greatest count.

Defined results: null and empty texts have no words; words are counted over all rows, repeated rows too; rows without
a ``doc_id`` count, and none of their words is changed by ``dropped_letters``; words of any length and any code
points compare by code points; without words there are no rows; input columns other than those named don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortscope.llm.base import query, table, written

MIN_LENGTH = 6
MIN_COUNT = 5
RATIO = 5
DIMS = 32
LETTERS = "[A-Za-zÀ-ÿ]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BOX_ROWS = 8192
#: Letters of a box's words, which bounds boxes of very long words.
BOX_LETTERS = 400_000
#: Words that the trees are fitted on, about; hashes choose them.
SAMPLE = 50_000
LEAF = 24
#: Counts compared at a time.
BLOCK = 1_000_000
#: Greatest count told apart; equal beyond, which only brings words nearer.
MAX_LETTER = 30_000
DATA, SAME, LONGER = 0, 1, 2
ROUTED = "box long, kind int, word string, n long"
FOUND = "word string, n_near long, best_n long, best string"


def letter_counts(words: list[str]) -> np.ndarray:
    """Counts of the letter classes, a row of ``DIMS`` per word."""
    sizes = np.array([len(w) for w in words], np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    row = np.repeat(np.arange(len(words)), sizes)
    counts = np.bincount(row * DIMS + points % DIMS, minlength=len(words) * DIMS)
    return np.minimum(counts, MAX_LETTER).astype(np.int16).reshape(-1, DIMS)


def _halve(vectors: np.ndarray) -> tuple[int, int] | None:
    """The count that spreads most, and the bound that halves the vectors along it best."""
    spread = vectors.var(axis=0)
    dim = int(spread.argmax())
    if spread[dim] == 0:
        return None
    values, sizes = np.unique(vectors[:, dim], return_counts=True)
    cut = np.abs(np.cumsum(sizes)[:-1] * 2 - len(vectors)).argmin()
    return dim, int(values[cut + 1])


def fit_tree(vectors: np.ndarray, leaves: int, first: int = 0):
    """Nested (dim, bound, left, right), boxes as numbers from ``first`` on, and how many there are."""
    cut = _halve(vectors) if leaves > 1 and len(vectors) > 1 else None
    if cut is None:
        return first, 1
    dim, bound = cut
    low = vectors[:, dim] < bound
    left, n_left = fit_tree(vectors[low], leaves // 2, first)
    right, n_right = fit_tree(vectors[~low], leaves - leaves // 2, first + n_left)
    return (dim, bound, left, right), n_left + n_right


def reached(tree, vectors: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and boxes of every box within L1 distance ``radius``; radius 0 gives the own box."""
    rows, boxes = [], []

    def visit(node, at: np.ndarray, off: np.ndarray, distance: np.ndarray) -> None:
        if not len(at):
            return
        if not isinstance(node, tuple):
            rows.append(at)
            boxes.append(np.full(len(at), node))
            return
        dim, bound, left, right = node
        value = vectors[at, dim]
        for child, gap in ((left, value - (bound - 1)), (right, bound - value)):
            now = np.maximum(off[:, dim], gap)
            total = distance + now - off[:, dim]
            near = total <= radius
            moved = off[near]
            moved[:, dim] = now[near]
            visit(child, at[near], moved, total[near])

    n = len(vectors)
    visit(tree, np.arange(n), np.zeros((n, DIMS), np.int16), np.zeros(n, np.int16))
    return (np.concatenate(rows), np.concatenate(boxes)) if rows else (np.zeros(0, int), np.zeros(0, int))


def _route(trees: dict, origin: dict):
    """To each word's own box as data, and to every box that may hold a near word as a question."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").to_pylist()
            vectors, sizes = letter_counts(words), np.array([len(w) for w in words])
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                parts = []
                for kind, length, radius in ((DATA, size, 0), (SAME, size, 2), (LONGER, size - 1, 1)):
                    # A length that no sampled word has is one box; so is a length without words.
                    at, boxes = reached(trees.get(int(length), 0), vectors[own], radius)
                    parts.append((own[at], boxes + origin.get(int(length), -2 - int(length)), np.full(len(at), kind)))
                at, box, kind = (np.concatenate(x) for x in zip(*parts, strict=True))
                taken = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(box, pa.int64()), pa.array(kind, pa.int32()), taken.column("word"), taken.column("n")],
                    names=["box", "kind", "word", "n"],
                )

    return run


def close_pairs(data: np.ndarray, asked: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``data`` and ``asked`` within L1 distance ``radius``, by a k-d tree over ``data``."""
    left, right = [], []

    def compare(d: np.ndarray, a: np.ndarray) -> None:
        step = max(1, BLOCK // (len(d) * DIMS))
        for low in range(0, len(a), step):
            part = a[low : low + step]
            distance = np.abs(data[d][:, None, :] - asked[part][None, :, :]).sum(axis=2, dtype=np.int32)
            i, j = np.nonzero(distance <= radius)
            left.append(d[i])
            right.append(part[j])

    def visit(d: np.ndarray, a: np.ndarray) -> None:
        own = data[d]
        low, high = own.min(axis=0), own.max(axis=0)
        there = asked[a]
        gap = np.maximum(low - there, 0) + np.maximum(there - high, 0)
        a = a[gap.sum(axis=1, dtype=np.int32) <= radius]
        if not len(a):
            return
        cut = _halve(own) if len(d) > LEAF else None
        if cut is None:
            compare(d, a)
            return
        below = own[:, cut[0]] < cut[1]
        visit(d[below], a)
        visit(d[~below], a)

    if len(data) and len(asked):
        visit(np.arange(len(data)), np.arange(len(asked)))
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))


def _points(words: list[str], size: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), size)


def one_edit(data: np.ndarray, asked: np.ndarray, d: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Which pairs of rows differ by exactly one replaced letter, or by one that ``asked`` has more."""
    size, more = data.shape[1], asked.shape[1] > data.shape[1]
    near = np.zeros(len(d), bool)
    step = max(1, BLOCK // max(size, 1))
    for low in range(0, len(d), step):
        own, other = data[d[low : low + step]], asked[a[low : low + step]]
        if not more:
            near[low : low + step] = (own != other).sum(axis=1) == 1
            continue
        head = np.logical_and.accumulate(own == other[:, :-1], axis=1).sum(axis=1)
        tail = np.logical_and.accumulate((own == other[:, 1:])[:, ::-1], axis=1).sum(axis=1)
        near[low : low + step] = head + tail >= size
    return near


def _search_box(rows: pa.Table) -> pa.Table:
    """Near words of a box: per word and box, how many, and the best of them."""
    kind = rows.column("kind").to_numpy()
    words, n = rows.column("word").to_pylist(), rows.column("n").to_numpy()
    at = {k: np.flatnonzero(kind == k) for k in (DATA, SAME, LONGER)}
    one, other = [], []
    if len(at[DATA]):
        held = [words[i] for i in at[DATA]]
        size, vectors = len(held[0]), letter_counts(held)
        points = _points(held, size)
        for k, radius in ((SAME, 2), (LONGER, 1)):
            if not len(at[k]):
                continue
            asked = [words[i] for i in at[k]]
            d, a = close_pairs(vectors, letter_counts(asked), radius)
            near = one_edit(points, _points(asked, size + (k == LONGER)), d, a)
            d, a = at[DATA][d[near]], at[k][a[near]]
            # Words of one length ask each other; between lengths only the longer one asks.
            one += [a, d] if k == LONGER else [a]
            other += [d, a] if k == LONGER else [d]
    one, other = (np.concatenate(x) if x else np.zeros(0, int) for x in (one, other))
    best_first = np.array(sorted(range(len(words)), key=lambda i: (-n[i], words[i])), np.int64)
    place = np.empty(len(words), np.int64)
    place[best_first] = np.arange(len(words))
    order = np.lexsort((place[other], one))
    one, other = one[order], other[order]
    first = np.flatnonzero(np.concatenate([[True], one[1:] != one[:-1]])) if len(one) else np.zeros(0, int)
    counts = np.diff(np.append(first, len(one)))
    taken = pa.array(other[first], pa.int64())
    word = rows.column("word").combine_chunks()
    return pa.table(
        {
            "word": word.take(pa.array(one[first], pa.int64())),
            "n_near": pa.array(counts, pa.int64()),
            "best_n": rows.column("n").combine_chunks().take(taken),
            "best": word.take(taken),
        }
    )


def near_words(words: DataFrame, box_rows: int = BOX_ROWS) -> DataFrame:
    """word, n_near and the best near word with its count, for words (word, n; distinct) that have any."""
    size = F.char_length("word").alias("size")
    total = {r["size"]: r["count"] for r in words.groupBy(size).count().collect()}
    # About SAMPLE words, whatever their number: those whose hashes fall into a share of all hashes.
    share = min(1 << 30, (SAMPLE << 30) // max(1, sum(total.values())))
    chosen = F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < share
    sampled = sorted(r.word for r in words.filter(chosen).select("word").collect())
    by_size: dict[int, list[str]] = {}
    for word in sampled:
        by_size.setdefault(len(word), []).append(word)
    trees, origin, boxes = {}, {}, 1
    for length in sorted(by_size):
        rows = max(1, min(box_rows, BOX_LETTERS // max(length, 1)))
        leaves = -(-total[length] // rows)
        trees[length], count = fit_tree(letter_counts(by_size[length]), leaves)
        origin[length] = boxes
        boxes += count
    routed = words.select("word", F.col("n").cast("long").alias("n")).mapInArrow(_route(trees, origin), ROUTED)
    found = routed.groupBy("box").applyInArrow(_search_box, FOUND)
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return (
        found.groupBy("word")
        .agg(F.sum("n_near").alias("n_near"), best.alias("best"))
        .select("word", "n_near", (-F.col("best.n")).alias("best_n"), F.col("best.word").alias("best"))
    )


def last_forms(links: DataFrame, rounds: int) -> DataFrame:
    """word, root: ``links`` (word, form) followed ``2 ** rounds`` steps."""
    roots = written(links.select("word", F.col("form").alias("root")), "forms")
    for _ in range(rounds):
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        roots = written(
            roots.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")), "forms"
        )
    return roots


def spelling_variants(words: DataFrame, ratio: int = RATIO, box_rows: int = BOX_ROWS) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of ``words`` (word, n; distinct words)."""
    words = written(words.select("word", F.col("n").cast("long").alias("n")), "words")
    near = near_words(words, box_rows)
    far = F.col("best_n") >= ratio * F.col("n")
    told = words.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(far, F.col("best")).alias("form"),
        F.when(far, F.col("best_n")).alias("form_n"),
    )
    told = written(told, "near-words")
    low, high = told.agg(F.min("n"), F.max("n")).first()
    steps = 1 + math.log(high / max(low, 1), ratio) if high else 1
    roots = last_forms(told.filter("form IS NOT NULL"), math.ceil(math.log2(steps + 1)))
    return told.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def dropped_letters(doc_id: Column, run: Column) -> Column:
    """The run, or, by a fixed rule on crc32 of id and run, what is left of it without one letter."""
    h = F.crc32(F.concat(doc_id.cast("string"), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    without = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return F.when(h % 199 == 0, without).otherwise(run)


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: runs of letters in all texts, in small letters, as ``dropped_letters`` leaves them."""
    runs = docs.select(
        "doc_id", F.explode(F.regexp_extract_all(F.translate("text", CAPITALS, SMALL), F.lit(LETTERS), F.lit(0))).alias("run")
    )
    # One letter goes at most, so shorter runs can't reach the length.
    runs = runs.filter(F.char_length("run") >= min_length)
    changed = runs.select(dropped_letters(F.col("doc_id"), F.col("run")).alias("word"))
    counts = changed.filter(F.char_length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") >= min_count)


@query("op13_spelling_variants")
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words, forms and roots."""
    return spelling_variants(word_counts(table(spark, sf_dir, "documents").select("doc_id", "text")))
