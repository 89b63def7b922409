"""What changed between two listings, and tables that are computed again when their inputs change."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortscope.sources.sinks import is_complete

LISTED = "path string, length long, modified timestamp"


def versioned_catalog(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Recursive listing with ``path``, ``length`` and ``modified``; file contents are never read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(root)
        .select("path", "length", F.col("modificationTime").alias("modified"))
    )


def catalog_changes(stored: DataFrame, current: DataFrame, key: str = "path") -> DataFrame:
    """Rows of either listing that differ: ``added``, ``changed`` or ``removed`` in column ``change``.

    Everything but the key is compared, NULLs as equal; a removed row keeps its old columns. Both listings are
    aggregated by the key in one shuffle. A key that one listing repeats counts by its largest row.
    """
    columns = [c for c in current.columns if c != key]
    sides = stored.select(key, F.struct(*columns).alias("_old"), F.lit(None).alias("_new")).unionByName(
        current.select(key, F.lit(None).alias("_old"), F.struct(*columns).alias("_new"))
    )
    both = sides.groupBy(key).agg(F.max("_old").alias("_old"), F.max("_new").alias("_new"))
    change = (
        F.when(F.col("_old").isNull(), "added")
        .when(F.col("_new").isNull(), "removed")
        .when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    )
    now = F.coalesce("_new", "_old")
    return (
        both.withColumn("change", change)
        .filter(F.col("change").isNotNull())
        .select(key, *[now.getField(c).alias(c) for c in columns], "change")
    )


class StoredCatalog:
    """A listing kept under ``path``, one folder per version, with a pointer to the last finished one.

    ``refresh`` compares a new listing with the stored one and stores it; ``changes`` are what a job that keeps
    results per file has to add, redo and take away. An interrupted refresh leaves the last version in force.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> list[str]:
        if not is_complete(self.spark, f"{self.path}/versions"):
            return []
        logged = self.spark.read.schema("version string, at timestamp").parquet(f"{self.path}/versions")
        return [r.version for r in logged.orderBy(F.desc("at"), "version").limit(1).collect()]

    def stored(self, schema: str = LISTED) -> DataFrame:
        """The last stored listing, empty before the first refresh."""
        last = self._versions()
        if not last:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(f"{self.path}/listing-{last[0]}")

    def refresh(self, current: DataFrame) -> DataFrame:
        """Store ``current``, and return its changes against what was stored before."""
        before, version = self.stored(current.schema.simpleString()[7:-1].replace(":", " ")), uuid4().hex
        current.write.parquet(f"{self.path}/listing-{version}")
        now = self.spark.read.parquet(f"{self.path}/listing-{version}")
        entry = self.spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("at"))
        entry.write.mode("append").parquet(f"{self.path}/versions")
        return catalog_changes(before, now)


def inputs_version(spark: SparkSession, inputs: Sequence[str], parameters: str = "") -> str:
    """A name for the present state of input files or folders: their paths, lengths and modification times.

    One aggregated row reaches the driver. It doesn't depend on the order in which files are listed.
    """
    digest = [f"{len(inputs)}", parameters]
    for root in inputs:
        listed = versioned_catalog(spark, root).select(F.xxhash64("path", "length", "modified").alias("h"), "length")
        row = listed.agg(
            F.count(F.lit(1)), F.sum("length"), F.bit_xor("h"), F.sum(F.col("h").cast("decimal(38,0)"))
        ).first()
        digest += [root, *[str(v) for v in row]]
    text = F.sha2(F.lit("\n".join(digest)), 256)
    return spark.range(1).select(text).first()[0]


def memoize_inputs(
    spark: SparkSession, path: str, inputs: Sequence[str], build: Callable[[], DataFrame], parameters: str = ""
) -> DataFrame:
    """Read the table that ``build`` made from these ``inputs``; compute and store it if they changed since.

    Each state of the inputs has a folder of its own below ``path``, so a reader of an earlier state isn't
    disturbed, and inputs that return to a former state find their table. ``parameters`` names whatever else the
    result depends on. Inputs that change while ``build`` runs are noticed: the table then goes to no folder that
    a later call believes, and an error tells so.
    """
    version = inputs_version(spark, inputs, parameters)
    home = f"{path.rstrip('/')}/{version}"
    if not is_complete(spark, f"{home}/checked"):
        build().write.mode("overwrite").parquet(f"{home}/data")
        if inputs_version(spark, inputs, parameters) != version:
            raise RuntimeError("the inputs changed while the table was computed")
        spark.range(1).write.mode("overwrite").parquet(f"{home}/checked")
    return spark.read.parquet(f"{home}/data")
