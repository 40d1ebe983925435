"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import math
import os

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on: UTC for date arithmetic, AQE for runtime
# re-planning (coalescing, broadcast conversion from measured sizes, skew-join
# splitting), ANSI semantics left on (unsafe casts are written as try_cast).
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(
    master: str | None = None,
    app_name: str = "sondeo",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with the engine defaults applied.

    On a cluster pass ``master=None`` and let spark-submit decide; size
    ``shuffle_partitions`` to the data (AQE coalesces small ones at runtime).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    for k, v in conf.items():
        if not k.startswith("spark.sql."):
            continue
        spark.conf.set(k, v)
    return spark


def apply_defaults(spark: SparkSession) -> SparkSession:
    """Apply the SQL defaults to a session created elsewhere (e.g. by the driver)."""
    for k, v in DEFAULT_CONF.items():
        if k.startswith("spark.sql."):
            spark.conf.set(k, v)
    return spark


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Shared folder for checkpoints and intermediate tables.

    Reads ``spark.checkpoint.dir`` from the session (the cluster names a shared
    folder there). Only when it is unset in a local session (tests) a fallback
    is set; on a cluster a folder of one machine would be no shared one, so
    an unset setting is an error there.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return configured
    if not fallback and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = fallback or os.environ.get("SONDEO_LOCAL_CHECKPOINT_DIR", "/tmp/sondeo-checkpoints")
    sc.setCheckpointDir(path)
    spark.conf.set("spark.checkpoint.dir", path)
    return sc.getCheckpointDir() or path


TARGET_PARTITION_BYTES = 64 * 1024 * 1024


def reliable_cache(df: DataFrame, row_bytes: int | None = None, task_rows: int | None = None) -> DataFrame:
    """Cut lineage for iterative jobs: checkpoint to the shared checkpoint
    folder (``spark.checkpoint.dir``), then cache the checkpointed frame.

    The input is staged in the cache first so that computing and writing the
    checkpoint evaluate the upstream plan once. With ``row_bytes`` the staged
    frame is also right-sized: about 64 MB per partition and never fewer than
    the default parallelism, so every iteration schedules as many tasks as
    the data needs. With ``task_rows`` it has one partition for so many rows, however
    many partitions the shuffle before it had: for aggregates that stay small while their input grows. An executor lost during the iterations then costs a
    re-read of the checkpoint files, not a recomputation upstream.
    """
    checkpoint_dir(df.sparkSession)
    staged = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        frame = staged
        if row_bytes or task_rows:
            rows = staged.count()
            try:
                floor = df.sparkSession.sparkContext.defaultParallelism
                current = staged.rdd.getNumPartitions()
            except Exception:  # no RDD API (Spark Connect): keep the partitioning
                floor = current = 0
            target = max(1, math.ceil(rows / task_rows)) if task_rows else max(floor, math.ceil(rows * row_bytes / TARGET_PARTITION_BYTES))
            if current > target:
                frame = staged.coalesce(target)
        cp = frame.checkpoint(eager=True)
    finally:
        staged.unpersist()
    return cp.persist(StorageLevel.MEMORY_AND_DISK)
