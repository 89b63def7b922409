"""Tables stored by subject, so that selections and joins over them shuffle nothing.

A bucketed table is dealt by its key once, when it is written; every later window, aggregate and join on that
key then reads bucket by bucket. A bucket is one task, so this suits keys of bounded size: a subject with a
large share of all rows would stay whole in its task, where an ordinary join splits it. So the table records
the rows of its largest key when it is written, and ``co_located`` says no beyond a bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the property of a table that holds the rows of its largest key.
LARGEST = "cohortscope.largest_key_rows"
#: Rows of one key that a task may hold.
MAX_KEY_ROWS = 5_000_000


def write_bucketed(df: DataFrame, name: str, key: str, n_buckets: int, path: str | None = None) -> DataFrame:
    """Store ``df`` as table ``name``, sorted within ``n_buckets`` buckets of ``key``, and return the table.

    Give tables that are joined with each other the same number of buckets and keys of the same type. Where no
    key exceeds ``MAX_KEY_ROWS`` the rows are dealt like the buckets first, which makes a bucket one file; with
    a larger key every task writes its own part of each bucket, and no task receives that key whole.
    """
    counted = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    dealt = df.repartition(n_buckets, key) if counted <= MAX_KEY_ROWS else df
    writer = dealt.write.mode("overwrite").format("parquet").bucketBy(n_buckets, key).sortBy(key)
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    spark = df.sparkSession
    spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('{LARGEST}' = '{counted}')")
    return spark.table(name)


def bucketing(spark: SparkSession, name: str) -> tuple[int, str, int] | None:
    """Buckets, key and rows of the largest key of a table that ``write_bucketed`` wrote, else None."""
    told = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}
    largest = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}.get(LARGEST)
    if "Num Buckets" not in told or largest is None:
        return None
    return int(told["Num Buckets"]), told["Bucket Columns"].strip("[]`"), int(largest)


def co_located(spark: SparkSession, left: str, left_key: str, right: str, right_key: str) -> bool:
    """Whether two tables may be joined on these keys bucket by bucket, in tasks of bounded size."""
    one, two = bucketing(spark, left), bucketing(spark, right)
    if one is None or two is None:
        return False
    same_type = spark.table(left).schema[left_key].dataType == spark.table(right).schema[right_key].dataType
    return (
        same_type
        and one[:2] == (two[0], left_key)
        and two[1] == right_key
        and max(one[2], two[2]) <= MAX_KEY_ROWS
    )
