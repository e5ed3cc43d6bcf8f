"""Session settings the operators rely on, for tests, bench and tools.

On a cluster the caller brings its own session; the only settings the
operators need are a UTC session time zone (timestamps are NTZ) and AQE.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

BASE_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app: str = "spendlens", extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("SPENDLENS_DRIVER_MEMORY", "8g"))
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    try:
        spark.sparkContext.setLogLevel("ERROR")
    except Exception:  # noqa: BLE001 - Spark Connect
        pass
    ensure_checkpoint_dir(spark)
    return spark


def app_id(spark: SparkSession) -> str:
    """The application id (also under Spark Connect, where the driver's
    SparkContext is not reachable)."""
    try:
        return spark.sparkContext.applicationId
    except Exception:  # noqa: BLE001 - Spark Connect session
        return spark.conf.get("spark.app.id", None) or f"session-{id(spark)}"


def is_local(spark: SparkSession) -> bool:
    master = spark.conf.get("spark.master", "") or ""
    return master.startswith("local")


def ensure_checkpoint_dir(spark: SparkSession) -> str | None:
    """The cluster's shared checkpoint folder (``spark.checkpoint.dir``).
    Only in local mode, when none is set (tests), a scratch folder is picked;
    on a cluster without one the answer is ``None`` — a machine-local folder
    is never used there."""
    try:
        sc = spark.sparkContext
        current = sc._jsc.sc().getCheckpointDir()
    except Exception:  # noqa: BLE001 - Spark Connect: no driver context here
        d = spark.conf.get("spark.checkpoint.dir", None)
        if d or not is_local(spark):
            return d
        return tempfile.mkdtemp(prefix="spendlens-ckpt-")
    if current.isDefined():
        return current.get()
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not is_local(spark):
            return None
        d = tempfile.mkdtemp(prefix="spendlens-ckpt-")
    sc.setCheckpointDir(d)
    return d
