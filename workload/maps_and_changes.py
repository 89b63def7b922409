"""Feature maps with fixed signs, distinct sketches, and what changed between listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortscope.operators.embedding import landmark_map, project_2d
from cohortscope.operators.quality import selection_funnel
from cohortscope.operators.sketches import (
    distinct_sketches,
    estimates,
    funnel_sketches,
    merge_sketches,
    relative_error,
)
from cohortscope.session import scratch_dir
from cohortscope.sources.changes import StoredCatalog, memoize_inputs
from workload.base import SCANS_SQL, query, rounded, scans, table

LANDMARKS = 128
VECTORS_SQL = "x AS (SELECT vec_id, label, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS v FROM embeddings)"


def leading_sql(name: str, source: str) -> str:
    """Statements for ``name``: the leading eigenvector v and value of the symmetric matrix m in ``source``.

    The matrix, shifted to have no negative eigenvalue, is squared until only that direction is left. The
    vector's largest entry is positive.
    """
    return f"""
{name}_shifted AS (
  SELECT m, list_max(list_transform(m, lambda r: list_sum(list_transform(r, lambda e: abs(e))))) AS s FROM {source}
),
{name}_power AS (
  SELECT 0 AS i, list_transform(m, lambda r, a: list_transform(r, lambda e, b:
           (e + CASE WHEN a = b THEN s ELSE 0 END) / s)) AS p
  FROM {name}_shifted
  UNION ALL
  SELECT i + 1, list_transform(q, lambda r: list_transform(r, lambda e: e / t))
  FROM (SELECT i, q, list_sum(list_transform(q, lambda r, a: r[a])) AS t
        FROM (SELECT i, list_transform(p, lambda r: list_transform(p, lambda c: list_dot_product(r, c))) AS q
              FROM {name}_power WHERE i < 40))
),
{name}_vector AS (
  SELECT list_transform(p[k], lambda e: e / sqrt(p[k][k])) AS v
  FROM (SELECT p, list_position(diagonal, list_max(diagonal)) AS k
        FROM (SELECT p, list_transform(p, lambda r, a: r[a]) AS diagonal FROM {name}_power WHERE i = 40))
),
{name} AS (
  SELECT m, v, list_dot_product(v, list_transform(m, lambda r: list_dot_product(r, v))) AS value
  FROM {name}_shifted, {name}_vector
),
{name}_rest AS (
  SELECT list_transform(m, lambda r, a: list_transform(r, lambda e, b: e - value * v[a] * v[b])) AS m FROM {name}
)"""


@query(
    "project_2d",
    f"""WITH RECURSIVE {VECTORS_SQL},
        cells AS (SELECT vec_id, unnest(range(1, len(v) + 1)) AS j, unnest(v) AS e FROM x),
        centred AS (SELECT vec_id, j, e - avg(e) OVER (PARTITION BY j) AS e FROM cells),
        covariance AS (
          SELECT a.j, b.j AS k, sum(a.e * b.e) / ((SELECT count(*) FROM x) - 1) AS c
          FROM centred a JOIN centred b ON a.vec_id = b.vec_id GROUP BY 1, 2),
        matrix AS (
          SELECT list(r ORDER BY j) AS m FROM (SELECT j, list(c ORDER BY k) AS r FROM covariance GROUP BY j)),
        {leading_sql("one", "matrix")}, {leading_sql("two", "one_rest")}
        SELECT vec_id, label, round(list_dot_product(x.v, one.v), 6) AS dim_1,
               round(list_dot_product(x.v, two.v), 6) AS dim_2
        FROM x, one, two""",
)
def project_2d_query(spark, sf_dir):
    """The plane of the first two principal components."""
    plane = project_2d(table(spark, sf_dir, "embeddings"), "embedding")
    return plane.select("vec_id", "label", rounded("dim_1", 6), rounded("dim_2", 6))


@query(
    "landmark_map",
    f"""WITH RECURSIVE {VECTORS_SQL},
        marks AS (
          SELECT row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) AS i, v FROM x
          QUALIFY i <= {LANDMARKS}),
        away AS (
          SELECT vec_id, label, i,
                 list_sum(list_transform(list_zip(x.v, marks.v), lambda z: abs(z[1] - z[2]))) ** 2 AS d
          FROM x, marks),
        between_marks AS (
          SELECT a.i, b.i AS j, list_sum(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2]))) ** 2 AS d
          FROM marks a, marks b),
        means AS (SELECT i, avg(d) AS mean FROM between_marks GROUP BY i),
        doubly AS (
          SELECT w.i, w.j, -0.5 * (d - a.mean - b.mean + (SELECT avg(mean) FROM means)) AS c
          FROM between_marks w JOIN means a ON w.i = a.i JOIN means b ON w.j = b.i),
        matrix AS (
          SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(c ORDER BY j) AS r FROM doubly GROUP BY i)),
        {leading_sql("one", "matrix")}, {leading_sql("two", "one_rest")}
        SELECT vec_id, label,
               round(sum(-0.5 * one.v[away.i] / sqrt(one.value) * (d - mean)), 6) AS dim_1,
               round(sum(-0.5 * two.v[away.i] / sqrt(two.value) * (d - mean)), 6) AS dim_2
        FROM away JOIN means ON away.i = means.i, one, two
        GROUP BY vec_id, label""",
)
def landmark_map_query(spark, sf_dir):
    """The plane that keeps Manhattan distances, from 128 landmarks."""
    plane = landmark_map(table(spark, sf_dir, "embeddings"), "embedding", "vec_id", LANDMARKS, "manhattan")
    return plane.select("vec_id", "label", rounded("dim_1", 6), rounded("dim_2", 6))


@query(
    "distinct_sketches",
    f"""WITH {SCANS_SQL}
        SELECT scan_year, count(*) AS n_rows, count(DISTINCT pid) AS n_subjects, true AS within_error
        FROM scans GROUP BY scan_year""",
)
def distinct_sketches_query(spark, sf_dir):
    """Sketches stored per year and kernel, merged per year: are they within four standard errors?"""
    path = scratch_dir(spark, "sketches")
    rows = scans(spark, sf_dir)
    distinct_sketches(rows, "pid", ["scan_year", "kernel"]).write.parquet(path)
    merged = estimates(merge_sketches(spark.read.parquet(path), ["scan_year"]))
    exact = rows.groupBy("scan_year").agg(F.countDistinct("pid").alias("n_subjects"))
    return _judged(merged.join(exact, "scan_year")).select("scan_year", "n_rows", "n_subjects", "within_error")


def _judged(both):
    off = F.abs(F.col("n_distinct") - F.col("n_subjects"))
    return both.withColumn("within_error", off <= F.ceil(4 * relative_error() * F.col("n_subjects")))


@query(
    "funnel_sketches",
    f"""WITH {SCANS_SQL},
        steps AS (SELECT pid, plane = 'O' AS a, thickness <= 25 AS b, scan_year >= 1996 AS c FROM scans)
        SELECT 0 AS step, 'input' AS step_name, count(*) AS n_rows, count(DISTINCT pid) AS n_subjects,
               true AS within_error FROM steps
        UNION ALL SELECT 1, 'plane', count(*), count(DISTINCT pid), true FROM steps WHERE a
        UNION ALL SELECT 2, 'thin', count(*), count(DISTINCT pid), true FROM steps WHERE a AND b
        UNION ALL SELECT 3, 'recent', count(*), count(DISTINCT pid), true FROM steps WHERE a AND b AND c""",
)
def funnel_sketches_query(spark, sf_dir):
    """The funnel of each kernel's scans, stored as sketches and merged by step."""
    path = scratch_dir(spark, "funnels")
    rows = scans(spark, sf_dir)
    steps = [
        ("plane", F.col("plane") == "O"),
        ("thin", F.col("thickness") <= 25),
        ("recent", F.col("scan_year") >= 1996),
    ]
    for part in (F.col("kernel") == "R", F.col("kernel") != "R"):
        funnel_sketches(rows.filter(part), "pid", steps).write.mode("append").parquet(path)
    merged = estimates(merge_sketches(spark.read.parquet(path), ["step", "step_name"]))
    exact = selection_funnel(rows, "pid", steps).select("step", "n_subjects")
    return _judged(merged.join(exact, "step")).select("step", "step_name", "n_rows", "n_subjects", "within_error")


LISTING = "concat('/texts/', lang, '/', doc_id) AS path"


@query(
    "catalog_changes",
    f"""WITH stored AS (SELECT {LISTING}, n_chars AS length FROM documents WHERE doc_id % 7 <> 0),
             seen AS (SELECT {LISTING}, n_chars + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS length
                      FROM documents WHERE doc_id % 5 <> 0)
        SELECT coalesce(s.path, c.path) AS path, coalesce(c.length, s.length) AS length,
               CASE WHEN s.path IS NULL THEN 'added' WHEN c.path IS NULL THEN 'removed' ELSE 'changed' END AS change
        FROM stored s FULL JOIN seen c ON s.path = c.path
        WHERE s.path IS NULL OR c.path IS NULL OR s.length <> c.length""",
)
def catalog_changes_query(spark, sf_dir):
    """A listing of the texts against the one stored before."""
    texts = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("/texts/"), "lang", F.lit("/"), "doc_id").alias("path")
    grown = (F.col("n_chars") + F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)).alias("length")
    catalog = StoredCatalog(spark, scratch_dir(spark, "catalog"))
    catalog.refresh(texts.filter("doc_id % 7 <> 0").select(path, F.col("n_chars").alias("length")))
    return catalog.refresh(texts.filter("doc_id % 5 <> 0").select(path, grown))


@query("memoize_inputs", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def memoize_inputs_query(spark, sf_dir):
    """The second call finds the table made from the same files."""
    path, inputs = scratch_dir(spark, "memo-inputs"), [f"{sf_dir}/orders.parquet"]
    counted = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    memoize_inputs(spark, path, inputs, lambda: counted)
    return memoize_inputs(spark, path, inputs, lambda: 1 / 0)
