"""The folder that a cluster's driver and executors share, and tables of a query in it."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN = os.path.join(tempfile.gettempdir(), f"spindrift-{uuid.uuid4().hex}")
_made: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session names it. Where it is unset, a folder of this process if Spark is one process, else ValueError."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _OWN


def own_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder in the shared one, which remove() or the end of the process removes."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def remove(path: str) -> None:
    """Removes a folder of own_folder(); what reads it can't be used any more."""
    spark = _made.pop(path, None)
    if spark is None:
        return
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  Spark ended before the process
        shutil.rmtree(path.removeprefix("file:"), ignore_errors=True)


@atexit.register
def release() -> None:
    """Removes all folders of own_folder()."""
    for path in list(_made):
        remove(path)
