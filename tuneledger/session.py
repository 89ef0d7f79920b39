"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import SparkSession

#: Shuffle files go with the action that made them, not when the driver happens to collect its garbage; files take less room.
_SPARING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.parquet.compression.codec": "zstd"}


def build_session(cores: str = "8", app_name: str = "tuneledger", driver_memory: str = "16g") -> SparkSession:
    """Local session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own, once per session.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not configured:
        if not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tuneledger-"))
        configured = context.getCheckpointDir()
    return configured.rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new folder name inside the shared folder; never reused, and gone only if its job drops it."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def drop_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder that a job has written for itself and will not read again."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def sparing_disk(spark: SparkSession) -> Iterator[None]:
    """Settings for actions whose results are written and read again, so that their shuffles are needed once."""
    before = {name: spark.conf.get(name) for name in _SPARING}
    for name, value in _SPARING.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def spares_disk(job: Callable) -> Callable:
    """A job on a warehouse or session that runs with :func:`sparing_disk`."""
    @wraps(job)
    def run(owner, *args, **kwargs):
        with sparing_disk(getattr(owner, "spark", owner)):
            return job(owner, *args, **kwargs)
    return run
