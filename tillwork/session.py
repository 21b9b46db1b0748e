"""Session settings and the shared folder for stage tables."""

from __future__ import annotations

import os
import tempfile
import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_writes, _writes_lock = {"open": 0, "before": None}, threading.Lock()


def local_session(cpus: str | int = "*", app: str = "tillwork") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own: a temporary
    folder of one machine would not be visible to the executors of a cluster.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="tillwork-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Tables written inside leave no shuffle files behind: they are removed when the write ends.

    Otherwise they stay until the driver happens to collect its garbage, so that the disk holds the
    shuffles of all tables written so far. The tables are read back and never computed anew.
    """
    with _writes_lock:
        if not _writes["open"]:
            _writes["before"] = spark.conf.get(_CLEANUP, None)
            spark.conf.set(_CLEANUP, "true")
        _writes["open"] += 1
    try:
        yield
    finally:
        with _writes_lock:
            _writes["open"] -= 1
            if not _writes["open"]:
                spark.conf.set(_CLEANUP, _writes["before"]) if _writes["before"] is not None else spark.conf.unset(_CLEANUP)
