"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job of this package expects. AQE turns a sort-merge join into a
# broadcast join only after it has measured the small side, and splits hot partitions otherwise.
SESSION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(app_name: str = "cohortscope", master: str | None = None, **conf) -> SparkSession:
    """A session with the package's settings; ``conf`` entries (dots as ``__``) win over them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = dict(SESSION_CONF)
    settings.update({key.replace("__", "."): str(value) for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession, *folders: str) -> None:
    """Make source folders importable in Python workers, once per session.

    The programmatic form of ``spark-submit --py-files``, for sessions started without it.
    """
    context = spark.sparkContext
    for folder in folders:
        name = os.path.basename(folder)
        if f"{name}.zip" not in {os.path.basename(f) for f in context.listFiles}:
            base = os.path.join(tempfile.mkdtemp(prefix="package-"), name)
            archive = shutil.make_archive(base, "zip", os.path.dirname(folder), name)
            context.addPyFile(archive)


def scratch_dir(spark: SparkSession, label: str) -> str:
    """The path of a folder, not made yet, that every executor can reach.

    It lies under ``spark.checkpoint.dir``. A session on one machine may leave that unset (tests) and
    gets a temporary folder; on several machines each would write to a disk of its own, so that is an
    error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{tempfile.mkdtemp(prefix=f'{label}-')}/data"
