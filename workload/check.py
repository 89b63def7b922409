"""Compare queries with their SQL: ``python -m workload.check [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canonical(value):
    """A sortable, engine-neutral form of one value."""
    if value is None:
        return ("null", "")
    if isinstance(value, bool):
        return ("bool", str(value))
    if isinstance(value, int):
        return ("num", f"{float(value):.10g}" if abs(value) < 2**53 else str(value))
    if isinstance(value, float):
        return ("num", "nan" if math.isnan(value) else f"{value + 0.0:.10g}")
    return ("text", str(value))


def family(value) -> str:
    return canonical(value)[0] if not isinstance(value, (int, float)) else type(value).__name__


def compare(spark_df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if both sides hold the same rows under the same names, else what differs."""
    names = sorted(spark_df.columns)
    mine = [tuple(r[n] for n in names) for r in spark_df.collect()]
    con.execute(sql)
    theirs_names = [d[0] for d in con.description]
    if sorted(theirs_names) != names:
        return f"columns {names} against {sorted(theirs_names)}"
    places = [theirs_names.index(n) for n in names]
    theirs = [tuple(r[p] for p in places) for r in con.fetchall()]
    if len(mine) != len(theirs):
        return f"{len(mine)} rows against {len(theirs)}"
    if not mine:
        return "no rows on either side"
    for position, name in enumerate(names):
        kinds = [
            {family(r[position]) for r in rows if r[position] is not None} for rows in (mine, theirs)
        ]
        if kinds[0] != kinds[1]:
            return f"column {name}: {kinds[0]} against {kinds[1]}"
    left, right = (sorted(tuple(map(canonical, r)) for r in rows) for rows in (mine, theirs))
    for a, b in zip(left, right, strict=True):
        if a != b:
            return f"first difference {[v for _, v in a]} against {[v for _, v in b]}"
    return ""


def main(argv: list[str]) -> int:
    from workload import all_queries

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    queries, oracles = all_queries()
    wanted = [n for n in queries if len(argv) < 2 or any(p in n for p in argv[1:])]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in wanted:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                problem = compare(df, con, oracles[name])
            else:
                problem = "" if df.count() else "no rows"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        failed += bool(problem)
        note = "" if name in oracles else " (rows only)"
        print(f"{'FAIL' if problem else 'ok  '} {time.time() - start:6.2f}s {name}{note} {problem}", flush=True)
    print(f"{len(wanted) - failed} of {len(wanted)} agree")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
