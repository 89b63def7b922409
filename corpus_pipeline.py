"""A training corpus from raw documents: five stages, each a table that the next one reads.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to the
shared folder and gives the next stage what it reads back. All but the last return the columns of
``documents``.

Defined results: null and empty texts go the way of each stage's operator (low quality, one group of
near duplicates, unchanged, no leak, the end id alone); of near duplicates the row of the smallest
``doc_id`` stays, of repeated rows one, and rows without a ``doc_id`` all stay; an empty table gives an empty result; further columns pass.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortscope.llm.base import ship, table, written
from cohortscope.llm.decontamination import decontaminated
from cohortscope.llm.packing import pieces
from cohortscope.llm.quality import THRESHOLD, score_quality
from cohortscope.llm.sentence_spans import remove_repeated
from cohortscope.llm.simhash import near_duplicates

#: SQL can't express the classifier, the fingerprints or the tokenizer.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    scored = score_quality(docs, table(spark, sf_dir, "labels"))
    return scored.filter(F.col("score") >= THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of the smallest id.

    The ids of groups are the ids to keep, so what decides is a table of numbers.
    """
    first = near_duplicates(docs).select(F.col("component_id").alias("doc_id")).filter("doc_id IS NOT NULL")
    kept = docs.join(first.distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.select(*docs.columns).union(docs.filter("doc_id IS NULL"))


def drop_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without sentences repeated from earlier ones; what has no text left goes."""
    cut = remove_repeated(docs).filter((F.col("n_removed") == 0) | (F.length("text") > 0))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        length = F.when(F.col("n_removed") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars"))
        cut = cut.withColumn("n_chars", length)
    return cut.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 4096 tokens."""
    return pieces(docs)


def _shipped(stage):
    """The stage, with the package made importable in Python workers first."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("quality classifier", _shipped(keep_quality)),
    ("simhash near-dedup", _shipped(drop_near_duplicates)),
    ("substring dedup", _shipped(drop_repeated_spans)),
    ("benchmark decontamination", _shipped(drop_contaminated)),
    ("packing", _shipped(pack_tokens)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
