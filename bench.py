"""Time the headline queries: prints one JSON line.

``BENCH_SF_DIR`` (default the sf0.1 tables), ``BENCH_CPUS`` (default 8) and ``BENCH_ALL=1`` (every
registered query instead of the headline ones) set the run.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cohortscope.session import build_session  # noqa: E402
from workload import all_queries  # noqa: E402

HEADLINE = [
    "labelled_cohort_baseline",
    "priority_tiers",
    "resolve_by_suffix",
    "first_per_group",
    "add_timepoint",
    "dedupe_keep_first",
    "selection_funnel",
    "minmax_scale_255",
    "slice_number",
    "feature_combinations",
    "mean_ci",
    "five_number_summary",
    "survival_metrics",
    "roc_curve_by_arm",
    "auprc",
    "concordance_index",
    "bootstrap",
    "bootstrap_survival",
    "bootstrap_cells",
    "bootstrap_joint",
    "sql_auroc",
    "observed_checks",
    "bonferroni",
    "score_cases",
    "score_resume",
    "project_2d",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = all_queries()
    names = list(queries) if os.environ.get("BENCH_ALL") else HEADLINE
    # One untimed run starts the Python workers and loads Spark's classes.
    queries["survival_metrics"](spark, sf_dir).collect()
    times = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
