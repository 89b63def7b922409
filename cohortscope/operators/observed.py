"""Data-quality checks that ride along with the job that writes a table.

    checked, report = observe_checks(cohort, "cohort", not_null=["event"], size=1200)
    write_cases(checked, path)
    report().show()          # what the write saw; no further pass over the data

Counts are collected by the tasks that produce the rows (``DataFrame.observe``) and added up as they end, so a check costs
no scan, no shuffle and no second evaluation of the plan. ``require`` is the strict form: a row that breaks a
condition fails the job itself, before its output is committed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

REPORT = "check string, detail string, n long, as_expected boolean"


def _count(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def observe_checks(
    df: DataFrame,
    name: str,
    not_null: Sequence[str] = (),
    size: int | None = None,
    implies: dict[str, tuple[Column, Column]] | None = None,
    equal_counts: dict[str, tuple[Column, Column]] | None = None,
    steps: Sequence[tuple[str, Column]] = (),
) -> tuple[DataFrame, Callable[[], DataFrame]]:
    """``df``, to be used instead of it, and a function that gives the report once an action has run on it.

    The report has a row (``check``, ``detail``, ``n``, ``as_expected``) for each of: the NULLs of a ``not_null`` column; the
    number of rows against ``size``; rows that break ``a <=> b`` of an ``implies`` pair; how many rows more meet the
    first than the second of an ``equal_counts`` pair; rows left after each of ``steps`` (name, condition to stay),
    where ``as_expected`` is NULL. Unknown conditions count as not met. Several uses of ``df`` in one job, or several
    jobs, don't add up: the first action that ends counts.
    """
    kinds: list[tuple[str, str, Column, Callable[[int], bool] | None]] = []
    kinds += [("not_null", c, _count(F.col(c).isNull()), lambda n: n == 0) for c in not_null]
    if size is not None:
        kinds.append(("size", str(size), F.count(F.lit(1)), lambda n: n == size))
    for title, (a, b) in (implies or {}).items():
        broken = F.coalesce(a, F.lit(False)) != F.coalesce(b, F.lit(False))
        kinds.append(("implies", title, _count(broken), lambda n: n == 0))
    for title, (a, b) in (equal_counts or {}).items():
        kinds.append(("equal_counts", title, _count(a) - _count(b), lambda n: n == 0))
    left = F.lit(True)
    if steps:
        kinds.append(("step", "input", F.count(F.lit(1)), None))
    for title, stays in steps:
        left = left & F.coalesce(stays, F.lit(False))
        kinds.append(("step", title, _count(left), None))
    if not kinds:
        raise ValueError("nothing to check")
    observation = Observation(name)
    observed = df.observe(observation, *[k[2].cast("long").alias(f"m{i}") for i, k in enumerate(kinds)])

    def report() -> DataFrame:
        """Waits for the first action on the observed table."""
        found = observation.get
        rows = []
        for i, (check, detail, _, holds) in enumerate(kinds):
            n = int(found.get(f"m{i}") or 0)
            rows.append((check, detail, n, None if holds is None else holds(n)))
        return df.sparkSession.createDataFrame(rows, REPORT)

    return observed, report


def require(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """``df`` unchanged, but any row that doesn't meet a condition fails the job, with the condition's name."""
    broken = F.lit(None).cast("string")
    for title, condition in reversed(conditions.items()):
        broken = F.when(~F.coalesce(condition, F.lit(False)), F.lit(title)).otherwise(broken)
    failed = F.raise_error(F.concat(F.lit("check failed: "), broken)).cast("boolean")
    return df.filter(F.when(broken.isNull(), True).otherwise(failed))


def require_not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` unchanged; a NULL in one of the columns fails the job."""
    return require(df, {f"{c} is never NULL": F.col(c).isNotNull() for c in columns})
