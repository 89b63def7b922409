import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortscope import schemas
from cohortscope.operators.embedding import project_2d
from cohortscope.operators.scoring import score_cases, score_resume, score_with_features, unscored
from cohortscope.session import scratch_dir
from cohortscope.sources.catalog import (
    check_paths_exist,
    file_catalog,
    file_catalog_by_folder,
    files_per_folder,
    first_file_per_folder,
    with_levels,
)
from cohortscope.sources.sinks import memoize, write_by_label, write_cases
from cohortscope.sources.tables import normalize_headers, read_cases, read_indexed_csv, read_json_map
from cohortscope.streaming.incremental import score_new_files
from tests.conftest import rows


def test_csv_with_bom_quotes_and_odd_headers(spark, tmp_path):
    path = tmp_path / "nodules.csv"
    path.write_text(
        "﻿pid,Nodule Number,\"Nodule Center x,y Position*\",Nodule Center Image,Final Diagnosis,diagnosis\n"
        'A1,1,"405, 296",43,"Said ""benign"" ",0\nA2,2,missing,None,,-1\n',
        encoding="utf-8",
    )
    got = rows(read_cases(spark, str(path), schemas.NODULES))
    assert got == [("A1", 1, "405, 296", 43, 'Said "benign" ', 0), ("A2", 2, None, None, None, -1)]
    inferred = read_cases(spark, str(path))
    assert inferred.columns[0] == "pid" and inferred.count() == 2


def test_csv_round_trip_and_nan(spark, tmp_path):
    df = spark.createDataFrame([("a, \"b\"", 1.5, None), ("c", float("nan"), "x")], "t string, d double, s string")
    write_cases(df, str(tmp_path / "out"))
    assert rows(read_cases(spark, str(tmp_path / "out"), df.schema)) == [("a, \"b\"", 1.5, None), ("c", None, "x")]


def test_indexed_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text(",patient_id,lung_cancer\n0,p,1\n1,q,0\n")
    schema = T.StructType().add("row", "integer").add("patient_id", "string").add("lung_cancer", "integer")
    assert rows(read_indexed_csv(spark, str(tmp_path / "x.csv"), schema)) == [("p", 1), ("q", 0)]


def test_json_map(spark, tmp_path):
    (tmp_path / "one.json").write_text('{\n "s1": {"boxes": 2},\n "s2": {"boxes": 0}\n}')
    got = read_json_map(spark, str(tmp_path / "one.json"), T.StructType().add("boxes", "integer"), whole_document=True)
    assert rows(got, "series", "annotation.boxes") == [("s1", 2), ("s2", 0)]


def test_catalog(spark, tmp_path):
    for name in ("p1/t1/s1/DICOM/b.dcm", "p1/t1/s1/DICOM/a.dcm", "p2/t1/s9/DICOM/z.dcm", "p2/t1/s9/DICOM/note.txt"):
        target = tmp_path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(b"123")
    catalog = file_catalog(spark, str(tmp_path), "*.dcm", ["patient", "timepoint", "scan"])
    assert rows(catalog, "patient", "timepoint", "scan", "length") == [("p1", "t1", "s1", 3)] * 2 + [("p2", "t1", "s9", 3)]
    patients = spark.createDataFrame([("p1",), ("p2",), ("p1",), ("gone",)], "pid string")
    by_folder = file_catalog_by_folder(patients, str(tmp_path), "*.dcm", ["patient", "timepoint", "scan"])
    columns = ["patient", "timepoint", "scan", "length"]
    assert rows(by_folder, *columns) == rows(catalog, *columns)
    firsts = [os.path.basename(r["first_file"]) for r in first_file_per_folder(catalog).orderBy("folder").collect()]
    assert firsts == ["a.dcm", "z.dcm"]
    assert [r["n_files"] for r in files_per_folder(catalog).orderBy("folder").collect()] == [2, 1]
    folder = catalog.select(F.regexp_replace("path", "/[^/]*$", "")).first()[0]
    cases = spark.createDataFrame([(1, folder), (2, "/nowhere")], "id int, Directory string")
    assert rows(check_paths_exist(cases, "Directory", catalog), "id") == [(2,)]


def test_levels_below_any_kind_of_root(spark):
    for root, path in (
        ("hdfs://node:8020/data/ct", "hdfs://node:8020/data/ct/p1/t1/x.dcm"),
        ("s3a://bucket", "s3a://bucket/p1/t1/x.dcm"),
        ("file:///data", "file:/data/p1/t1/x.dcm"),
        ("/data/", "file:/data/p1/t1/x.dcm"),
    ):
        catalog = spark.createDataFrame([(path,)], "path string")
        assert rows(with_levels(catalog, root, ["p", "t"]), "p", "t") == [("p1", "t1")]


def test_listing_does_not_read_contents(spark, tmp_path):
    (tmp_path / "a.dcm").write_bytes(b"x")
    plan = file_catalog(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]


def test_headers(spark):
    df = spark.createDataFrame([("p", 2.5, None)], "pid string, SliceThickness double, ConvolutionKernel string")
    got = normalize_headers(df, {"SliceThickness": "thickness", "ConvolutionKernel": "kernel", "Absent": "other"})
    assert rows(got) == [("p", "2.5", "missing", "missing")]


def test_memoize_builds_once_and_ignores_unfinished_output(spark, tmp_path):
    path = str(tmp_path / "memo")
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    assert memoize(spark, path, build).count() == 3
    assert memoize(spark, path, build).count() == 3
    os.remove(f"{path}/_SUCCESS")
    assert memoize(spark, path, build).count() == 3
    assert len(calls) == 2


def test_write_by_label_keeps_existing(spark, tmp_path):
    df = spark.createDataFrame([(1, "TP"), (2, "FN")], "id int, outcome string")
    write_by_label(df, str(tmp_path / "o"))
    write_by_label(df.filter("id = 1"), str(tmp_path / "o"))
    assert rows(spark.read.parquet(str(tmp_path / "o"))) == [(1, "TP"), (2, "FN")]


def test_scratch_dir_follows_the_cluster_setting(spark, tmp_path):
    class Conf:
        def get(self, key, default):
            assert key == "spark.checkpoint.dir"
            return "hdfs://shared/tmp/"

    class Session:
        conf = Conf()

    assert scratch_dir(Session(), "x").startswith("hdfs://shared/tmp/x-")


def doubler():
    return lambda batch: np.outer(batch["v"].to_numpy(), np.arange(1, 7))


def test_scoring(spark):
    df = spark.range(10).withColumn("v", F.col("id") * 1.0)
    got = score_cases(df, doubler)
    assert rows(got.filter("id = 3"), *schemas.score_columns()) == [(3.0, 6.0, 9.0, 12.0, 15.0, 18.0)]
    both = score_with_features(df, lambda: lambda b: (doubler()(b), np.stack([b["v"], -b["v"]], axis=1)))
    assert both.filter("id = 2").select("features").first()[0] == [2.0, -2.0]
    partly = got.withColumn("pred_risk_year_0", F.when(F.col("id") > 3, F.col("pred_risk_year_0")))
    assert unscored(partly).count() == 4


def test_resume_scores_each_case_once(spark, tmp_path):
    df = spark.range(40).withColumn("v", F.col("id") * 1.0)
    done = str(tmp_path / "done")

    def breaks():
        def predict(batch):
            if (batch["id"] >= 20).any():
                raise RuntimeError("model died")
            return doubler()(batch)

        return predict

    score_resume(df.filter("id < 10"), done, "id", breaks)
    with pytest.raises(Exception, match="model died"):
        score_resume(df, done, "id", breaks, n_chunks=2)
    final = score_resume(df, done, "id", doubler, n_chunks=3)
    assert final.count() == 40 and final.select("id").distinct().count() == 40
    assert score_resume(df, done, "id", lambda: lambda b: 1 / 0).count() == 40


def test_stream_scores_new_files_once(spark, tmp_path):
    source, done, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    df = spark.range(6).withColumn("v", F.col("id") * 1.0)
    for part in ("id < 3", "id >= 3"):
        df.filter(part).write.mode("append").parquet(source)
        query = score_new_files(spark, source, df.schema, done, state, doubler)
        assert query.awaitTermination(120)
    scored = spark.read.parquet(done)
    assert scored.count() == 6 and scored.select("id").distinct().count() == 6


def test_projection_matches_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 6)) * np.array([5, 3, 1, 1, 1, 1])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, f array<double>")
    got = np.array([tuple(r) for r in project_2d(df, "f").orderBy("id").select("dim_1", "dim_2").collect()])
    _, vectors = np.linalg.eigh(np.cov(x.T))
    expected = x @ vectors[:, ::-1][:, :2]
    assert np.allclose(np.abs(got), np.abs(expected), atol=1e-6)
