"""Session construction and the shared working folder."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid

from pyspark.sql import SparkSession

# Settings every rankflow job relies on.  Timestamps in the source documents are
# ISO strings in UTC.  Static (estimate-based) broadcast is off: an estimate is
# not a size bound (an exploded side is far larger than its file).  AQE
# broadcasts only sides whose *measured* shuffle output is under the adaptive
# threshold, and splits skewed partitions.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # of a repeated JSON key the last value counts, as in json.loads
    "spark.sql.variant.allowDuplicateKeys": "true",
    # streaming state (redelivery ids, per-job counts) lives off-heap in RocksDB
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "rankflow", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Let Python workers started from now on import this package from where the driver did.  (On a cluster whose
    executors have it elsewhere, ``--py-files`` or an installed package serves; this is then harmless.)"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` is read from the session.  Only a local master may
    leave it unset (a temporary folder is made); elsewhere that is an error,
    since other executors could not see a folder of the driver's own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="rankflow-ckpt-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    base = base.rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def spread(df, tasks: int | None = None):
    """Round-robin ``df`` over the cluster's cores when the scan produced
    fewer partitions than cores (small files, one row group), so CPU-heavy
    per-row work (JSON, regex, hashing) is not run by one task.  At scale the
    scan already yields many splits and this is a no-op.  Round-robin
    repartition sorts before distributing, so a retried task sees the same
    rows (``spark.sql.execution.sortBeforeRepartition``).

    With ``tasks`` the scan is trusted only if it has that many files: a split
    that holds no start of a row group is an empty task, so splits say little
    about rows."""
    if df.isStreaming:
        return df
    target, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    if tasks is None:
        return df.repartition(target) if splits < target else df
    target = max(target, tasks, splits)
    return df.repartition(target) if len(df.inputFiles()) < target else df


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of steps whose results are written: they go when the plans that made them are
    collected, which a driver with little garbage puts off.  (What one
    collection lets go of, the next one frees.)"""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
