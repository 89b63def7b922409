"""Token counts through a cache of digests.

A cache holds one row per normalised content and tokenizer version, both as digests, with the number
of tokens. ``count_tokens`` joins the documents' digests to it, encodes each distinct content that is
missing once, appends those counts, and joins again. Copies of a text cost one encoding, and a second
run over the same texts, or over more of them, encodes only what is new.

Contents are normalised as far as every tokenizer allows: null becomes the empty text. White space and
letters count for the token numbers and stay. The version digest covers the vocabulary file's bytes and the
way it is called, so a new file never meets old counts.

Defined results: null and empty texts have 0 bytes, and the tokens that the tokenizer gives the empty
text; a null ``doc_id`` and repeated rows are kept, a row each; an empty table gives no rows; other
columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortscope.llm.base import query, rebatched, table
from cohortscope.llm.tokens import vocabulary
from cohortscope.operators.skew import join_aggregated
from cohortscope.session import scratch_dir

CACHE_SCHEMA = "tokenizer string, content binary, n_tokens long"
LIMIT = 4096
_loaded: dict[str, object] = {}


def _counter(path: str):
    """A function from texts to token counts, kept in the worker."""
    if path not in _loaded:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _loaded[path] = lambda texts: [len(model.encode(t)) for t in texts]
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            _loaded[path] = lambda texts: [
                len(e.ids) for e in model.encode_batch_fast(texts, add_special_tokens=False)
            ]
    return _loaded[path]


def tokenizer_version(path: str) -> str:
    """A digest of the vocabulary file and of how it is used."""
    with open(path, "rb") as f:
        return hashlib.sha256(b"plain, no special tokens added:" + f.read()).hexdigest()


def _count_missing(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path)
        for batch in rebatched(batches, "text", 1_000_000):
            counts = count(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("content"), pa.array(counts, pa.int64())], names=["content", "n_tokens"]
            )

    return run


def _digest(text):
    return F.unhex(F.sha2(text, 256))


def read_cache(spark: SparkSession, cache_path: str, version: str) -> DataFrame | None:
    """Counts of one tokenizer version, or None where nothing has been stored yet."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{cache_path}/_SUCCESS")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return None
    cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    # Two runs at once may both store a content; its counts are equal.
    stored = cache.filter(F.col("tokenizer") == version).select("content", "n_tokens")
    return stored.groupBy("content").agg(F.min("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, vocabulary_path: str, cache_path: str) -> DataFrame:
    """doc_id, n_bytes and n_tokens of ``docs`` (doc_id, text), by way of the cache at ``cache_path``.

    Texts move once, and of copies only one text per task: the grouping by digest takes the first
    text of each already before the shuffle. The join back moves ids and digests alone.
    """
    spark, version = docs.sparkSession, tokenizer_version(vocabulary_path)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    distinct = rows.groupBy(_digest(F.col("text")).alias("content")).agg(F.first("text").alias("text"))
    stored = read_cache(spark, cache_path, version)
    missing = distinct if stored is None else distinct.join(stored, "content", "left_anti")
    (
        missing.select("content", "text")
        .mapInArrow(_count_missing(vocabulary_path), "content binary, n_tokens long")
        .select(F.lit(version).alias("tokenizer"), "content", "n_tokens")
        .write.mode("append")
        .parquet(cache_path)
    )
    keyed = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), _digest(F.col("text")).alias("content"))
    counts = read_cache(spark, cache_path, version)
    return join_aggregated(keyed, counts, ["content"]).select("doc_id", "n_bytes", "n_tokens")


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document with the 32k piece vocabulary, through a cache of this run."""
    counted = count_tokens(
        table(spark, sf_dir, "documents"),
        vocabulary("piece_bpe_32k.model"),
        scratch_dir(spark, "token-counts"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
