import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortscope.operators.embedding import landmark_map, project_2d
from cohortscope.operators.sketches import (
    distinct_sketches,
    estimates,
    funnel_sketches,
    merge_sketches,
    relative_error,
)
from cohortscope.sources.changes import (
    StoredCatalog,
    catalog_changes,
    inputs_version,
    memoize_inputs,
    versioned_catalog,
)
from tests.conftest import rows


def vectors(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, f array<double>")


def planes(df):
    return np.array([tuple(r) for r in df.orderBy("id").select("dim_1", "dim_2").collect()], float)


def test_components_have_the_sign_of_their_largest_loading(spark):
    x = np.random.default_rng(0).normal(size=(80, 6)) * np.array([5, 3, 1, 1, 1, 1])
    _, directions = np.linalg.eigh(np.cov(x.T))
    top = directions[:, ::-1][:, :2]
    top = top * np.sign(top[np.abs(top).argmax(axis=0), [0, 1]])
    assert np.allclose(planes(project_2d(vectors(spark, x), "f")), x @ top, atol=1e-8)


def test_landmarks_keep_the_distances_of_a_plane(spark):
    rng = np.random.default_rng(1)
    flat = rng.normal(size=(60, 2)) * np.array([4, 1])
    x = flat @ np.linalg.qr(rng.normal(size=(7, 7)))[0][:2]
    got = planes(landmark_map(vectors(spark, x), "f", "id", n_landmarks=20))
    between = np.linalg.norm(flat[:, None] - flat[None, :], axis=2)
    assert np.allclose(np.linalg.norm(got[:, None] - got[None, :], axis=2), between, atol=1e-8)
    again = planes(landmark_map(vectors(spark, x).repartition(7), "f", "id", n_landmarks=20))
    assert np.allclose(got, again, atol=1e-10)
    # Landmarks of all rows make classical scaling, also under another metric.
    own = np.abs(x[:, None] - x[None, :]).sum(axis=2) ** 2
    centre = np.eye(60) - 1 / 60
    values, directions = np.linalg.eigh(-0.5 * centre @ own @ centre)
    full = planes(landmark_map(vectors(spark, x), "f", "id", 60, "manhattan"))
    assert np.allclose(np.abs(full), np.abs(directions[:, ::-1][:, :2] * np.sqrt(values[::-1][:2])), atol=1e-6)


def test_maps_of_odd_rows(spark):
    data = [(1, [0.0, 1.0], "a"), (2, None, "b"), (3, [0.0, 1.0], "c"), (4, [None, 1.0], "d"), (5, [3.0, 1.0], "e")]
    df = spark.createDataFrame(data, "id int, f array<double>, k string")
    got = {r.id: (r.dim_1, r.dim_2) for r in landmark_map(df, "f", "id").collect()}
    assert got[2] == got[4] == (None, None) and got[1] == got[3]
    assert abs(abs(got[5][0] - got[1][0]) - 3) < 1e-9 and got[1][1] == got[5][1] == 0
    assert landmark_map(df.limit(0), "f", "id").count() == 0
    assert landmark_map(df.filter("id = 2"), "f", "id").first().dim_1 is None
    with pytest.raises(ValueError):
        landmark_map(df, "f", "id", metric="other")
    with pytest.raises(ValueError):
        landmark_map(df, "f", "id", n_landmarks=0)


def test_sketches_merge_to_the_number_of_all(spark):
    df = spark.range(60_000).select((F.col("id") % 17).alias("day"), F.pmod(F.xxhash64("id"), F.lit(9_000)).alias("pid"))
    df = df.withColumn("pid", F.when(df.day > 0, df.pid))
    stored = distinct_sketches(df, "pid", ["day"])
    per_day = {r.day: r for r in estimates(stored).collect()}
    exact = {r.day: r.n for r in df.groupBy("day").agg(F.countDistinct("pid").alias("n")).collect()}
    assert per_day[0].n_distinct == 0 and sum(r.n_rows for r in per_day.values()) == 60_000
    assert all(abs(per_day[d].n_distinct - n) <= 4 * relative_error() * n for d, n in exact.items())
    whole = estimates(merge_sketches(stored)).first()
    assert abs(whole.n_distinct - 9_000) <= 4 * relative_error() * 9_000 and whole.n_rows == 60_000
    # Sizes may differ, keys of any type count, and an empty table has an empty answer.
    small = distinct_sketches(df.withColumn("pid", F.col("pid").cast("decimal(12,0)")), "pid", lg_size=10)
    assert abs(estimates(small).first().n_distinct - 9_000) <= 4 * relative_error(10) * 9_000
    assert estimates(merge_sketches(stored.limit(0), ["day"])).count() == 0
    with pytest.raises(ValueError):
        distinct_sketches(df, "pid", lg_size=30)


def test_sketched_funnel_moves_no_keys(spark):
    data = [(1, 5), (1, None), (2, 1), (None, 9), (3, 9)]
    df = spark.createDataFrame(data, "pid int, v int")
    got = estimates(funnel_sketches(df, "pid", [("big", F.col("v") > 3), ("bigger", F.col("v") > 6)]))
    assert rows(got, "step", "step_name", "n_rows", "n_distinct") == [
        (0, "input", 5, 3), (1, "big", 3, 2), (2, "bigger", 2, 1),
    ]
    assert "keys=[]" in got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()


def test_changes_of_listings(spark):
    schema = "path string, length long, modified string"
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "x"), ("c", None, "x"), ("d", 4, None)], schema)
    new = spark.createDataFrame([("a", 1, "x"), ("b", 3, "x"), ("c", 5, "x"), ("e", 4, None)], schema)
    assert rows(catalog_changes(old, new)) == [
        ("b", 3, "x", "changed"), ("c", 5, "x", "changed"), ("d", 4, None, "removed"), ("e", 4, None, "added"),
    ]
    assert catalog_changes(old, old).count() == 0 and catalog_changes(old.limit(0), new).count() == 4


def put(folder, name, text):
    (folder / name).write_text(text)


def test_stored_catalog_follows_files(spark, tmp_path):
    tree, home = tmp_path / "tree", str(tmp_path / "stored")
    (tree / "deep").mkdir(parents=True)
    put(tree, "a.txt", "one")
    put(tree / "deep", "b.txt", "two")
    put(tree, "c.csv", "not listed")
    catalog = StoredCatalog(spark, home)
    assert catalog.stored().count() == 0
    seen = [(r.path[-5:], r.change) for r in catalog.refresh(versioned_catalog(spark, str(tree), "*.txt")).collect()]
    assert sorted(seen) == [("a.txt", "added"), ("b.txt", "added")]
    put(tree, "a.txt", "longer")
    put(tree, "d.txt", "new")
    (tree / "deep" / "b.txt").unlink()
    changes = catalog.refresh(versioned_catalog(spark, str(tree), "*.txt"))
    assert sorted((r.path[-5:], r.change) for r in changes.collect()) == [
        ("a.txt", "changed"), ("b.txt", "removed"), ("d.txt", "added"),
    ]
    assert StoredCatalog(spark, home).refresh(versioned_catalog(spark, str(tree), "*.txt")).count() == 0


def test_memo_follows_its_inputs(spark, tmp_path):
    source, home, built = tmp_path / "in", str(tmp_path / "memo"), []
    source.mkdir()
    put(source, "a.csv", "1\n2\n")

    def build():
        built.append(1)
        return spark.read.schema("v int").csv(str(source))

    def got(parameters=""):
        return rows(memoize_inputs(spark, home, [str(source)], build, parameters))

    assert got() == got() == [(1,), (2,)] and len(built) == 1
    put(source, "b.csv", "3\n")
    assert got() == [(1,), (2,), (3,)] and len(built) == 2
    put(source, "a.csv", "10\n2\n")
    assert got() == [(10,), (2,), (3,)] and len(built) == 3
    (source / "b.csv").unlink()
    assert got() == got() == [(10,), (2,)] and len(built) == 4
    assert got("other") == [(10,), (2,)] and len(built) == 5
    assert inputs_version(spark, [str(source)]) != inputs_version(spark, [str(source)], "other")

    def meddling():
        put(source, "late.csv", "7\n")
        return spark.range(1)

    with pytest.raises(RuntimeError):
        memoize_inputs(spark, home, [str(source)], meddling, "third")
    assert memoize_inputs(spark, home, [str(source)], build, "third").count() == 3
