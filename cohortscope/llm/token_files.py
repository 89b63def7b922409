"""Token-ID output: whole texts as Parquet list columns, in order, readable in parts.

``write_token_files`` puts every document's ids into one row of a Parquet data set, sorted by
document: the files hold ascending ranges of ``doc_id``, and so do the row groups and pages in them.
A file's columns are ``doc_id``, ``part`` (the number of the file's range), ``part_start`` (ids before
the document in its part), ``n_tokens`` and the list column ``ids``. Ids are dictionary encoded, which
packs them into the bits that the row group's vocabulary needs; ``encoding="delta"`` writes version 2
pages with delta-packed integers instead. Row groups and pages have the sizes asked for, and Spark's
writer adds column and offset indexes. So metadata can be read without ids, and the ids of a range of
documents without those of others. A small table beside the files, the index, has each part's totals and
the number of ids before it.

Defined results: a null text is an empty text, so it holds the end id alone; a null ``doc_id`` sorts
first; rows with equal ``doc_id`` follow each other in the order of their texts' hashes; repeated rows
are all kept; an empty table gives no rows; other columns of the input are not read, whatever their
names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortscope.llm.base import query, rebatched, table
from cohortscope.llm.tokens import SLICE, encoder, vocabulary
from cohortscope.session import scratch_dir

END_ID = 2
FILE_SCHEMA = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"
INDEX_SCHEMA = "part int, documents long, tokens long, start long"
ENCODINGS = {
    "dictionary": {"parquet.enable.dictionary": "true", "parquet.writer.version": "PARQUET_1_0"},
    "delta": {"parquet.enable.dictionary": "false", "parquet.writer.version": "PARQUET_2_0"},
}


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same documents with ``end_id`` behind each."""
    n = len(offsets) - 1
    return np.insert(ids, offsets[1:], end_id), offsets + np.arange(n + 1)


def _encode_parts(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, done = encoder(path).encode, TaskContext.get().partitionId(), 0
        for batch in rebatched(batches, "text", SLICE):
            ids, offsets = with_end(*encode(batch.column("text")), end_id)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.full(n, part, np.int32)),
                    pa.array(offsets[:-1] + done),
                    pa.array(np.diff(offsets)),
                    pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32))),
                ],
                names=["doc_id", "part", "part_start", "n_tokens", "ids"],
            )
            done += int(offsets[-1])

    return run


def write_token_files(
    docs: DataFrame,
    path: str,
    vocabulary_path: str,
    end_id: int = END_ID,
    encoding: str = "dictionary",
    row_group_bytes: int = 32 << 20,
    page_bytes: int = 256 << 10,
    compression: str = "zstd",
) -> None:
    """Encode ``docs`` (doc_id, text) and write token files and their index under ``path``.

    Texts move once, into ranges of ``doc_id``; the range boundaries come from Spark's own sample, so
    that parts are of like size whatever the ids are. A part is encoded as a stream.
    """
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
    )
    (
        ordered.mapInArrow(_encode_parts(vocabulary_path, end_id), FILE_SCHEMA)
        .write.options(
            **ENCODINGS[encoding],
            **{
                "parquet.block.size": str(row_group_bytes),
                "parquet.page.size": str(page_bytes),
                "compression": compression,
            },
        )
        .parquet(f"{path}/tokens")
    )
    # One row per part: a part is as large as a task's share of the input, so these are few.
    totals = (
        docs.sparkSession.read.schema(FILE_SCHEMA)
        .parquet(f"{path}/tokens")
        .groupBy("part")
        .agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"))
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    (
        totals.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
        .write.parquet(f"{path}/index")
    )


def read_token_files(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Token files as doc_id, start (ids of all documents before it), n_tokens and ids.

    Only the columns asked for are read; a filter on ``doc_id`` skips files, row groups and pages.
    """
    tokens = spark.read.schema(FILE_SCHEMA).parquet(f"{path}/tokens")
    index = spark.read.schema(INDEX_SCHEMA).parquet(f"{path}/index").select("part", "start")
    columns = columns or ["doc_id", "start", "n_tokens", "ids"]
    if "start" not in columns:
        return tokens.select(*columns)
    kept = [c for c in columns if c != "start"]
    return (
        tokens.select("part", "part_start", *kept)
        .join(index, "part")
        .withColumn("start", F.col("start") + F.col("part_start"))
        .select(*columns)
    )


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        values = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        bounds = ids.offsets.to_pylist()
        sums = [zlib.crc32(values[a:z]) for a, z in zip(bounds[:-1], bounds[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "part", "part_start", "n_tokens")), pa.array(sums, pa.int64())],
            names=["doc_id", "part", "part_start", "n_tokens", "ids_crc32"],
        )


@query("op5_token_files")
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and checksum, read back from the token files of the whole table."""
    path = scratch_dir(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"))
    summed = read_token_files(spark, path, ["doc_id", "part", "part_start", "n_tokens", "ids"]).mapInArrow(
        _checksums, "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long"
    )
    index = spark.read.schema(INDEX_SCHEMA).parquet(f"{path}/index").select("part", "start")
    return summed.join(index, "part").select(
        "doc_id", (F.col("start") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32"
    )
