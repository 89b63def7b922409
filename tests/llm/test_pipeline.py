from pyspark.sql import functions as F

import corpus_pipeline
from cohortscope.llm.base import written

SF_DIR = "/root/testdata/sf0.001"


def test_stages_on_a_whole_table(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF_DIR), "stage")
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[0] > counts[1] > counts[2] >= counts[3] > counts[4] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    sums = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all"))
    assert sums.filter("n <> all").count() == 0 and sums.count() == counts[-1]
    assert corpus_pipeline.run(spark, SF_DIR).count() == packed.count()


def test_near_duplicates_keep_one_each_and_rows_without_id(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(4, text), (2, text), (2, text), (7, "something else here"), (None, text), (7, "yet another one")]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, component_id string")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SF_DIR)
    assert got.columns == docs.columns
    assert sorted(map(str, got.select("doc_id", "text").collect())) == sorted(
        map(str, docs.filter("doc_id IS NULL OR doc_id <> 4").select("doc_id", "text").distinct().collect())
    )


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_DIR)
        assert out.count() == 0
