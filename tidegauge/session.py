"""Session construction and the shared working folder.

Every operator runs in whatever session it is given.  ``build_session`` holds
the settings we recommend for a large cluster; it is used by the tests and the
benchmark as well.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

BATCH_SETTINGS = {
    # Timestamps in the tables are UTC wall clock.
    "spark.sql.session.timeZone": "UTC",
    # Runtime re-planning: merges small shuffle blocks, splits hot ones, and
    # switches a join to broadcast only when the measured side is small.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# Keyed window state lives in an embedded store on the executors' disks and only
# the changes of a batch are uploaded to the checkpoint folder.
STREAM_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.minBatchesToRetain": "3",
}


def build_session(
    app_name: str = "tidegauge",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    **extra: str,
) -> SparkSession:
    """Create (or get) a session with the recommended settings."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {**BATCH_SETTINGS, **STREAM_SETTINGS, **extra}
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def stream_settings(spark: SparkSession):
    """Apply ``STREAM_SETTINGS`` while a query starts, then restore the session.

    A streaming query copies the session's settings when it starts, so the
    caller's own configuration is left as it was.
    """
    before = {key: spark.conf.get(key, None) for key in STREAM_SETTINGS}
    for key, value in STREAM_SETTINGS.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Let the shuffle files of each query run inside be deleted when it ends, not when the driver collects its garbage.

    For steps that write their tables: what a later query reads is a table, not a shuffle.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


#: Folders that ``work_dir`` has named in this process.
_named: list[str] = []


@contextmanager
def scratch(spark: SparkSession):
    """Delete the folders that ``work_dir`` names inside, when they are done with, but for those put into the list given."""
    start, kept = len(_named), []
    yield kept
    for path in _named[start:]:
        if path not in kept:
            files, root = hadoop_path(spark, path)
            files.delete(root, True)
    _named[start:] = [path for path in _named[start:] if path in kept]


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the cluster's shared ``spark.checkpoint.dir``.

    Where that setting is missing a temporary folder is used, but only in local
    mode: on a cluster the executors could not see the driver's disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="tidegauge-")
    path = f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    _named.append(path)
    return path


def hadoop_path(spark: SparkSession, path: str):
    """The file system of a path, and the path."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), root
