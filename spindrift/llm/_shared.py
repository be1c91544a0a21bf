"""Intermediate tables in the folder that a cluster shares, and connected components over them."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import threading
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.sources.shared import shared_dir

_made: dict[str, SparkSession] = {}


def _drop(spark: SparkSession, path: str) -> None:
    """Removes a table; a session that has ended, or a folder that is gone, is no error."""
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  Spark ended before the process
        shutil.rmtree(path.removeprefix("file:"), ignore_errors=True)


@atexit.register
def release() -> None:
    """Removes all saved tables; results that still read them can't be used any more."""
    for path in list(_made):
        _drop(_made.pop(path), path)


#: The tables that the innermost scratch() of this thread has to look after.
_open: ContextVar[list[str] | None] = ContextVar("open", default=None)


@contextlib.contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """On leaving, removes the tables that this thread saved inside, but for those of the DataFrames in the list."""
    own: list[str] = []
    kept: list[DataFrame] = []
    before = _open.set(own)
    try:
        yield kept
    finally:
        _open.reset(before)
        stay = {df._saved_at for df in kept}
        for path in own:
            if path not in stay and path in _made:
                _drop(_made.pop(path), path)
        if (outer := _open.get()) is not None:
            outer += [path for path in own if path in stay]


#: Spark's own switch for removing an execution's shuffle files when it has ended, and its limits on Arrow batches, while a table is saved.
_SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}
#: By session: how many tables are being saved, and the settings that it had before.
_held: dict[int, tuple[int, dict[str, str | None]]] = {}
_lock = threading.Lock()


@contextlib.contextmanager
def _settings(spark: SparkSession) -> Iterator[None]:
    """The session with _SETTINGS for a while; when the last of its threads is done, what it had comes back."""
    with _lock:
        n, was = _held.get(id(spark), (0, {}))
        if not n:
            was = {k: spark.conf.get(k, None) for k in _SETTINGS}
            for k, v in _SETTINGS.items():
                spark.conf.set(k, v)
        _held[id(spark)] = n + 1, was
    try:
        yield
    finally:
        with _lock:
            n, was = _held.pop(id(spark))
            if n > 1:
                _held[id(spark)] = n - 1, was
            else:
                for k, v in was.items():
                    spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def saved(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, so that no later loss of an executor repeats its work.

    The shuffle files that made it are of no use then and are removed. Python functions in df get Arrow batches
    of at most 2,000 rows and 16 MB. The session's settings are as before afterwards.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    if (own := _open.get()) is not None:
        own.append(path)
    with _settings(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of links(a long, b long): node, label, the component's smallest node.

    Every round takes the smallest label among a node's neighbours and then the label of that label,
    so the number of rounds follows the logarithm of a component's width. Null ends and loops are ignored;
    no links give no rows. All state is in tables; the driver sees one count a round.
    """
    with scratch() as kept:
        links = saved(links.where("a is not null and b is not null and a <> b").select("a", "b").distinct(), "links")
        both = links.union(links.select(F.col("b"), F.col("a")))
        labels = saved(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
        for _ in range(rounds):
            near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("m"))
            hooked = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("was"), F.least("label", "m").alias("label"))
            up = hooked.select(F.col("node").alias("label"), F.col("label").alias("top"))
            step = saved(hooked.join(up, "label", "left").select("node", "was", F.coalesce("top", "label").alias("label")), "labels")
            labels = step.select("node", "label")
            if not step.where("label <> was").limit(1).count():
                kept.append(step)
                return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
