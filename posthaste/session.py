"""Session settings and the shared scratch folder."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import SparkSession

# Seconds that Spark's cleaner gets between two collections.
CLEANER_S = 0.3


def build_session(app: str = "posthaste", master: str | None = None,
                  settings: dict[str, str] | None = None) -> SparkSession:
    """A session with the settings every job relies on.

    Shuffle sizing is left to adaptive execution: start from many partitions
    and let it merge small ones, so the same job fits 1 GB and 100 TB.
    """
    builder = (SparkSession.builder.appName(app)
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.sources.partitionOverwriteMode", "dynamic"))
    if master:
        builder = builder.master(master)
    for key, value in (settings or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def require_utc(spark: SparkSession) -> None:
    """Times without a zone are meant as UTC, so the session must say so."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
        raise ValueError(f"set spark.sql.session.timeZone to UTC; it is {zone}")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder in the shared place the cluster names.

    A machine-local folder is taken only for a local master with no setting.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        base = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def release_shuffles(spark: SparkSession) -> None:
    """Have the shuffle files of finished jobs deleted now.

    Spark deletes them once the driver's garbage collector finds that no job can
    ask for them again, which with a large heap may not happen before a disk is
    full. What Spark's cleaner drops after one collection still holds the shuffles
    of the last job; the second frees these.
    """
    gc.collect()
    spark._jvm.System.gc()
    time.sleep(CLEANER_S)
    spark._jvm.System.gc()
