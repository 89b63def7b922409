"""Metrics as table functions that SQL callers use.

    create_ranking_functions(spark, "trial", "scored", "pred", "label", by=["arm"])
    spark.sql("SELECT arm, auroc FROM trial_auroc()")
    spark.sql("SELECT * FROM trial_confusion(0.25)")

Each call declares functions over one relation (a table or view name), as ``CREATE TEMPORARY FUNCTION ... RETURNS
TABLE``. A function's body is SQL text that Spark puts in place of the call, so columns are pruned, filters are pushed
down and nothing runs in Python; arguments may be literals, parameters or, with LATERAL, columns. A relation's name
can't be an argument of a SQL function, which is why functions are declared per relation.

The bodies keep to the rules of the operators of the same names: rows are reduced to one cell per distinct value, and
orders over a whole relation are summed range by range (see ``operators.prefix``).
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql.types import StructType

from cohortscope.functions.normal import ERFC_COEFFICIENTS, ERFC_P
from cohortscope.operators.prefix import SAMPLES_PER_RANGE, default_ranges

RANKING = ("auroc", "roc_curve", "confusion", "youden")
SURVIVAL = ("censoring_distribution", "yearly_auroc", "concordance_index")
DATASETS = ("mann_whitney", "mean_ci")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _listed(names: Sequence[str], end: str = ", ") -> str:
    """Quoted names, each with ``end`` after it, so that no names leave nothing behind."""
    return "".join(f"{quoted(n)}{end}" for n in names)


def _declare(spark: SparkSession, name: str, body: str, returns: str, parameters: str = "") -> str:
    if not re.fullmatch(r"[A-Za-z_]\w*", name):
        raise ValueError(f"{name!r} can't be a function's name")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE ({returns}) RETURN {body}")
    return name


def _kinds(schema: StructType, names: Sequence[str]) -> str:
    return "".join(f"{quoted(n)} {schema[n].dataType.simpleString()}, " for n in names)


def running_totals_sql(
    cells: str, order: str, values: Sequence[str], by: Sequence[str], ranges: int, descending: bool = False
) -> str:
    """CTEs that end in ``<cells>_summed``: the CTE ``cells`` with ``cum_<v>`` and ``total_<v>`` of each value.

    Split points are quantiles of the cells of the smallest hashes; a range's running sums start from the sums of the
    ranges before it. No task holds more than one range of one group.
    """
    group, way = _listed(by), "DESC" if descending else "ASC"
    steps = ", ".join(str(1 << i) for i in range(max(1, ranges.bit_length()) - 1, -1, -1))
    sums = ", ".join(f"sum({v}) AS sum_{v}" for v in values)
    before = ", ".join(
        f"""coalesce(sum(sum_{v}) OVER (PARTITION BY {group}0 ORDER BY range_id {way}
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_{v},
            sum(sum_{v}) OVER (PARTITION BY {group}0) AS total_{v}"""
        for v in values
    )
    inside = ", ".join(
        f"""before_{v} + sum({v}) OVER (PARTITION BY {group}range_id ORDER BY {order} {way}
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_{v}, total_{v}"""
        for v in values
    )
    carried = "".join(f"{v}, " for v in values)
    return f"""
{cells}_sample AS (
  SELECT {order} FROM {cells} WHERE {order} IS NOT NULL
  ORDER BY xxhash64({group}{order}), {order} LIMIT {SAMPLES_PER_RANGE * ranges}),
{cells}_splits AS (
  SELECT transform(sequence(1, {ranges - 1}), i -> get(o, CAST(floor(i * size(o) / {ranges}) AS INT))) AS q
  FROM (SELECT array_sort(collect_list({order})) AS o FROM {cells}_sample)),
{cells}_spread AS (
  SELECT *, (SELECT q FROM {cells}_splits) AS q FROM {cells} WHERE {order} IS NOT NULL),
{cells}_placed AS (
  SELECT {group}{order}, {carried}explode(array(
    aggregate(array({steps}), 0, (low, s) -> IF(get(q, low + s - 1) <= {order}, low + s, low)))) AS range_id
  FROM {cells}_spread),
{cells}_ranges AS (SELECT {group}range_id, {sums} FROM {cells}_placed GROUP BY ALL),
{cells}_offsets AS (SELECT {group}range_id, {before} FROM {cells}_ranges),
{cells}_summed AS (
  SELECT {group}{order}, {carried}{inside}
  FROM {cells}_placed JOIN {cells}_offsets USING ({group}range_id))"""


def _score_cells(source: str, score: str, label: str, by: Sequence[str]) -> str:
    return f"""
cells AS (
  SELECT {_listed(by)}CAST({score} AS DOUBLE) AS threshold, count_if({label} = 1) AS pos, count_if({label} = 0) AS neg
  FROM {source}
  WHERE {label} IN (0, 1) AND NOT isnan(CAST({score} AS DOUBLE)) AND {score} IS NOT NULL{_present(by)}
  GROUP BY ALL)"""


def _present(by: Sequence[str]) -> str:
    return "".join(f" AND {quoted(b)} IS NOT NULL" for b in by)


def _areas(by: Sequence[str]) -> str:
    """AUROC and areas under the precision curve from summed cells; NULL where a class is missing."""
    group = ", ".join(quoted(b) for b in by)
    both = "max(total_pos) > 0 AND max(total_neg) > 0"
    precision = "cum_pos / (cum_pos + cum_neg)"
    before = "coalesce((cum_pos - pos) / nullif(cum_pos - pos + cum_neg - neg, 0), 1.0D)"
    return f"""
SELECT {_listed(by)}max(total_pos) AS n_pos, max(total_neg) AS n_neg,
       CASE WHEN {both} THEN sum(neg * (cum_pos - pos / 2.0D)) / (CAST(max(total_pos) AS DOUBLE) * max(total_neg)) END AS auroc,
       CASE WHEN {both} THEN sum(pos * ({precision} + {before}) / 2.0D) / max(total_pos) END AS auprc,
       CASE WHEN {both} THEN sum(pos * {precision}) / max(total_pos) END AS average_precision
FROM cells_summed {f"GROUP BY {group}" if by else ""}"""


def create_ranking_functions(
    spark: SparkSession, name: str, relation: str, score: str, label: str, by: Sequence[str] = (), ranges: int | None = None
) -> list[str]:
    """Declare ``<name>_auroc()``, ``_roc_curve()``, ``_confusion(cutoff)`` and ``_youden()`` over ``relation``.

    ``auroc`` gives class counts, AUROC, AUPRC and average precision; ``confusion`` the four counts at a cutoff;
    ``youden`` the highest threshold of the largest tpr - fpr. All per group of ``by``.
    """
    schema = spark.table(relation).schema
    kinds, group = _kinds(schema, by), _listed(by)
    score, label = quoted(score), quoted(label)
    summed = running_totals_sql("cells", "threshold", ["pos", "neg"], by, ranges or default_ranges(spark.table(relation)), True)
    cells = _score_cells(relation, score, label, by) + "," + summed
    curve = f"""
points AS (
  SELECT {group}threshold, cum_neg / nullif(total_neg, 0) AS fpr, cum_pos / nullif(total_pos, 0) AS tpr FROM cells_summed
  UNION ALL
  SELECT {group}double('Infinity'), 0.0D, 0.0D FROM cells_summed WHERE cum_pos = pos AND cum_neg = neg)"""
    # Parameters can't stand inside aggregates, so conditions on them are columns first.
    hit = f"""
SELECT {group}count_if(y = 1 AND over) AS tp, count_if(y = 0 AND over) AS fp,
       count_if(y = 1 AND NOT over) AS fn, count_if(y = 0 AND NOT over) AS tn
FROM (SELECT {group}{label} AS y, {score} >= cutoff AS over FROM {relation} WHERE NOT isnan(CAST({score} AS DOUBLE)))
{f"GROUP BY {', '.join(map(quoted, by))}" if by else ""}"""
    best = "max(struct(tpr - fpr AS youden, threshold, fpr, tpr)) AS best FROM points WHERE tpr - fpr IS NOT NULL"
    youden = f"SELECT {group}{best}" + (f" GROUP BY {', '.join(map(quoted, by))}" if by else "")
    counts = "n_pos BIGINT, n_neg BIGINT, auroc DOUBLE, auprc DOUBLE, average_precision DOUBLE"
    return [
        _declare(spark, f"{name}_auroc", f"WITH {cells} {_areas(by)}", kinds + counts),
        _declare(
            spark, f"{name}_roc_curve", f"WITH {cells}, {curve} SELECT {group}threshold, fpr, tpr FROM points",
            kinds + "threshold DOUBLE, fpr DOUBLE, tpr DOUBLE",
        ),
        _declare(spark, f"{name}_confusion", hit, kinds + "tp BIGINT, fp BIGINT, fn BIGINT, tn BIGINT", "cutoff DOUBLE"),
        _declare(
            spark, f"{name}_youden",
            f"WITH {cells}, {curve} SELECT {group}best.threshold, best.fpr, best.tpr, best.youden FROM ({youden})",
            kinds + "threshold DOUBLE, fpr DOUBLE, tpr DOUBLE, youden DOUBLE",
        ),
    ]


def create_survival_functions(
    spark: SparkSession, name: str, relation: str, scores: Sequence[str], time: str, event: str, ranges: int | None = None
) -> list[str]:
    """Declare ``<name>_censoring_distribution()``, ``_yearly_auroc()`` and ``_concordance_index()`` over ``relation``.

    Years count from 1 and use the score of their place in ``scores``, as in ``operators.survival``.
    """
    ranges = ranges or default_ranges(spark.table(relation))
    time, event = quoted(time), quoted(event)
    kind = spark.table(relation).schema[time[1:-1]].dataType.simpleString()
    counted = f"""
times AS (
  SELECT {time} AS t, count(*) AS n, count_if({event} = 0) AS n_censored FROM {relation}
  WHERE {time} IS NOT NULL AND {event} IS NOT NULL AND NOT isnan(CAST({time} AS DOUBLE)) GROUP BY 1),
{running_totals_sql("times", "t", ["n"], (), ranges, True)},
factors AS (
  SELECT s.t, cum_n AS n_at_risk, n_censored, IF(cum_n > n_censored, ln(1.0D - n_censored / cum_n), 0.0D) AS log_factor,
         IF(cum_n > n_censored, 0, 1) AS emptied
  FROM times_summed s JOIN times USING (t)),
{running_totals_sql("factors", "t", ["log_factor", "emptied"], (), ranges)},
km AS (
  SELECT f.t, n_at_risk, n_censored, IF(cum_emptied > 0, 0.0D, exp(cum_log_factor)) AS g
  FROM factors_summed s JOIN factors f USING (t))"""
    years = ", ".join(
        f"""struct({i + 1} AS year, CAST({quoted(s)} AS DOUBLE) AS score,
            CASE WHEN {event} = 1 AND {time} <= {i} THEN 1 WHEN {time} >= {i} THEN 0 END AS label,
            CASE WHEN {event} = 1 AND {time} = {i} THEN 1 WHEN {time} > {i} THEN 0 END AS compared)"""
        for i, s in enumerate(scores)
    )
    long = f"yearly AS (SELECT inline(array({years})) FROM {relation})"
    cells = running_totals_sql("cells", "threshold", ["pos", "neg"], ["year"], ranges, True)
    labelled = f"{long}, {_score_cells('yearly', 'score', 'label', ['year'])}, {cells}"
    compared = f"{long}, {_score_cells('yearly', 'score', 'compared', ['year'])}, {cells}"
    index = f"""
WITH {counted}, {compared},
per_year AS (
  SELECT year - 1 AS t, sum(neg * (cum_pos - pos / 2.0D)) AS won, CAST(max(total_pos) AS DOUBLE) * max(total_neg) AS pairs
  FROM cells_summed GROUP BY year),
weighted AS (SELECT won, pairs, IF(g > 0, 1 / (g * g), 0.0D) AS w FROM per_year JOIN km ON CAST(km.t AS INT) = per_year.t)
SELECT CAST(sum(pairs) AS BIGINT) AS n_pairs, IF(sum(w * pairs) > 0, sum(w * won) / sum(w * pairs), NULL) AS c_index FROM weighted"""
    areas = "n_pos BIGINT, n_neg BIGINT, auroc DOUBLE, auprc DOUBLE, average_precision DOUBLE"
    return [
        _declare(
            spark, f"{name}_censoring_distribution", f"WITH {counted} SELECT t, n_at_risk, n_censored, g FROM km",
            f"time {kind}, n_at_risk BIGINT, n_censored BIGINT, g DOUBLE",
        ),
        _declare(spark, f"{name}_yearly_auroc", f"WITH {labelled} {_areas(['year'])}", "year INT, " + areas),
        _declare(spark, f"{name}_concordance_index", index, "n_pairs BIGINT, c_index DOUBLE"),
    ]


def create_dataset_functions(
    spark: SparkSession, name: str, relation: str, value: str, dataset: str, ranges: int | None = None
) -> list[str]:
    """Declare ``<name>_mann_whitney(baseline)`` and ``<name>_mean_ci(lower, upper)`` over ``relation``.

    The first tests every other dataset against the one named, the second gives mean and linear-interpolated
    percentiles (0.025 and 0.975 unless told otherwise) of every dataset.
    """
    frame = spark.table(relation)
    ranges = ranges or default_ranges(frame)
    kind = frame.schema[dataset].dataType.simpleString()
    value, dataset = quoted(value), quoted(dataset)
    known = f"{value} IS NOT NULL AND NOT isnan(CAST({value} AS DOUBLE)) AND {dataset} IS NOT NULL"
    cells = f"cells AS (SELECT {dataset} AS d, {value} AS v, count(*) AS n FROM {relation} WHERE {known} GROUP BY ALL)"
    cubes = "CAST({0} AS DOUBLE) * {0} * {0} - {0}".format
    tail = "0.0D"
    for c in reversed(ERFC_COEFFICIENTS):
        tail = f"({tail} + ({c!r}D)) * k"
    tests = f"""
WITH {cells},
sides AS (SELECT d, v, n, IF(d = baseline, n, 0) AS of_base FROM cells),
base AS (SELECT v, b, {cubes("b")} AS b_ties FROM (SELECT v, sum(of_base) AS b FROM sides GROUP BY v)),
{running_totals_sql("base", "v", ["b", "b_ties"], (), ranges)},
summed AS (
  SELECT d, max(total_b) AS n1, sum(n) AS n2, sum(n * (total_b - cum_b + b / 2.0D)) AS u,
         max(total_b_ties) + sum({cubes("(n + b)")} - ({cubes("b")})) AS ties
  FROM sides JOIN base_summed USING (v) WHERE of_base = 0 GROUP BY d),
spread AS (
  SELECT *, sqrt(CAST(n1 AS DOUBLE) * n2 / 12 * (n1 + n2 + 1 - ties / (CAST(n1 + n2 AS DOUBLE) * (n1 + n2 - 1)))) AS sd FROM summed),
scaled AS (
  SELECT *, IF(sd > 0, greatest(abs(u - CAST(n1 AS DOUBLE) * n2 / 2) - 0.5D, 0.0D) / sd, NULL) AS z FROM spread),
tails AS (SELECT *, z / sqrt(2.0D) AS x, 1 / (1 + {ERFC_P!r}D * z / sqrt(2.0D)) AS k FROM scaled)
SELECT d, n1, n2, u, z, least({tail} * exp(-x * x), 1.0D) FROM tails"""
    pick = "max(IF(cum_n - n <= {0}({1}) AND {0}({1}) < cum_n, CAST(v AS DOUBLE), NULL))".format

    def between(p: str) -> str:
        a, z = pick("floor", p), pick("ceil", p)
        return f"{a} + ({z} - {a}) * max({p} - floor({p}))"

    interval = f"""
WITH {cells}, {running_totals_sql("cells", "v", ["n"], ["d"], ranges)},
wanted AS (SELECT d, v, n, cum_n, (total_n - 1) * lower AS low, (total_n - 1) * upper AS high FROM cells_summed)
SELECT d, sum(n) AS n, sum(CAST(v AS DOUBLE) * n) / sum(n) AS mean, {between("low")} AS lower_bound, {between("high")} AS upper_bound
FROM wanted GROUP BY d"""
    first = f"{dataset} {kind}"
    return [
        _declare(
            spark, f"{name}_mann_whitney", tests,
            f"{first}, n_baseline BIGINT, n_other BIGINT, u DOUBLE, z DOUBLE, p_value DOUBLE", "baseline STRING",
        ),
        _declare(
            spark, f"{name}_mean_ci", interval, f"{first}, n BIGINT, mean DOUBLE, lower_bound DOUBLE, upper_bound DOUBLE",
            "lower DOUBLE DEFAULT 0.025, upper DOUBLE DEFAULT 0.975",
        ),
    ]
