"""Checks that ride along with a write, and a stream that scores each case once."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortscope.operators.observed import observe_checks, require_not_null
from cohortscope.session import scratch_dir
from cohortscope.streaming.incremental import score_new_files
from workload.base import CLINICAL_SQL, COHORT_SQL, clinical, cohort, query, table
from workload.evaluation import SCORED_SQL, linear_model, rounded_scores


@query(
    "observed_checks",
    f"""WITH {CLINICAL_SQL},
        facts AS (
          SELECT count(*) FILTER (scr_days0 IS NULL) AS a, count(*) FILTER (candx_days IS NULL) AS b,
                 count(*) FILTER (pid IS NULL) AS c, count(*) AS n,
                 count(*) FILTER ((conflc = 1) <> (candx_days IS NOT NULL)) AS broken,
                 count(*) FILTER (coalesce(scr_days1 > 600, false) <> coalesce(scr_days2 > 900, false)) AS loose,
                 count(*) FILTER (conflc = 1) - count(*) FILTER (fup_days > 2000) AS more
          FROM clinical)
        SELECT 'not_null' AS "check", 'scr_days0' AS detail, a AS n, a = 0 AS as_expected FROM facts
        UNION ALL SELECT 'not_null', 'candx_days', b, b = 0 FROM facts
        UNION ALL SELECT 'not_null', 'pid', c, c = 0 FROM facts
        UNION ALL SELECT 'size', '1000', n, n = 1000 FROM facts
        UNION ALL SELECT 'implies', 'diagnosed', broken, broken = 0 FROM facts
        UNION ALL SELECT 'implies', 'late visits', loose, loose = 0 FROM facts
        UNION ALL SELECT 'equal_counts', 'diagnosed and followed', more, more = 0 FROM facts""",
)
def observed_checks_query(spark, sf_dir):
    """What the job that wrote the clinical table saw on its way."""
    checked, report = observe_checks(
        clinical(spark, sf_dir),
        "clinical",
        not_null=["scr_days0", "candx_days", "pid"],
        size=1000,
        implies={
            "diagnosed": (F.col("conflc") == 1, F.col("candx_days").isNotNull()),
            "late visits": (F.col("scr_days1") > 600, F.col("scr_days2") > 900),
        },
        equal_counts={"diagnosed and followed": (F.col("conflc") == 1, F.col("fup_days") > 2000)},
    )
    checked.write.parquet(scratch_dir(spark, "clinical"))
    return report()


@query(
    "observed_funnel",
    f"""WITH {COHORT_SQL},
        seen AS (SELECT years_to_event >= 0 AS a, years_to_event <= 4 AS b, event = 1 AS c FROM cohort)
        SELECT 'step' AS "check", 'input' AS detail, count(*) AS n, NULL::BOOLEAN AS as_expected FROM seen
        UNION ALL SELECT 'step', 'time known', count(*) FILTER (a), NULL FROM seen
        UNION ALL SELECT 'step', 'within four years', count(*) FILTER (a AND b), NULL FROM seen
        UNION ALL SELECT 'step', 'diagnosed', count(*) FILTER (a AND b AND c), NULL FROM seen""",
)
def observed_funnel_query(spark, sf_dir):
    """Rows left after each exclusion, counted while the strictly checked selection is written."""
    steps = [
        ("time known", F.col("years_to_event") >= 0),
        ("within four years", F.col("years_to_event") <= 4),
        ("diagnosed", F.col("event") == 1),
    ]
    counted, report = observe_checks(require_not_null(cohort(spark, sf_dir), ["pid", "event"]), "funnel", steps=steps)
    for _, stays in steps:
        counted = counted.filter(stays)
    counted.write.parquet(scratch_dir(spark, "selected"))
    return report()


@query("score_stream", SCORED_SQL + " FROM embeddings")
def score_stream_query(spark, sf_dir):
    """Two deliveries that overlap, the first of them replayed under another name: each case is scored once."""
    source, done, state = (scratch_dir(spark, n) for n in ("deliveries", "scored", "stream-state"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    for part in ("label < 4", "label >= 2", "label < 4"):
        vectors.filter(part).write.mode("append").parquet(source)
        started = score_new_files(spark, source, vectors.schema, done, state, linear_model, key="vec_id")
        started.awaitTermination()
    return spark.read.parquet(done).select("vec_id", *rounded_scores())
