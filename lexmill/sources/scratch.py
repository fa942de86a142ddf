"""Where tables that are made once and read often are written."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session may have ended; what is left is in the shared folder
        pass


def shared_folder(spark: SparkSession, name: str = "index") -> str:
    """A new folder in spark.checkpoint.dir, which all executors share; it is deleted when the driver ends.

    Where the session names none, local mode gets a temporary one and a cluster an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lexmill-"))
        root = spark.sparkContext.getCheckpointDir()
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query in this block go when it ends, for tables that are read from what was written and never planned again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)
