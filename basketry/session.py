"""Spark session settings used by the library, tests and bench.

On a cluster the session already exists; ``configure`` only fills in the
settings the analyses rely on (UTC dates, AQE) and a checkpoint folder when
the cluster has not named one.  ``local_session`` is for tests and the bench.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every analysis relies on.  ANSI mode stays on (Spark 4 default):
# the library uses try_divide / nullif wherever the reference relied on
# SQLite's x/0 -> NULL.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in REQUIRED_CONF.items():
        if spark.conf.get(key, None) != value:
            try:
                spark.conf.set(key, value)
            except Exception:  # static conf on a shared session: leave it
                pass
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder: the cluster's ``spark.checkpoint.dir``
    if set.  Only a local session (tests, bench) gets a fresh folder under
    /tmp; on a cluster a machine-local folder would be wrong, so a missing
    setting is an error there."""
    try:
        sc = spark.sparkContext
    except Exception:  # e.g. a Spark Connect session: the server owns the setting
        return spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/object store): "
                               "global windows and top-k checkpoint their inputs there")
        configured = tempfile.mkdtemp(prefix="basketry-ckpt-", dir="/tmp")
    sc.setCheckpointDir(configured)
    return sc._jsc.sc().getCheckpointDir().get()


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "basketry", event_log_dir: str | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("BASKETRY_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # checkpoint files of unreferenced DataFrames are removed by the cleaner
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in REQUIRED_CONF.items():
        builder = builder.config(key, value)
    if event_log_dir:
        builder = (builder.config("spark.eventLog.enabled", "true")
                   .config("spark.eventLog.dir", event_log_dir))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)
