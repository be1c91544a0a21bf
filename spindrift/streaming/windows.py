"""Tumbling windows over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def totals(events: DataFrame, every: str = "1 hour", late: str = "1 day") -> DataFrame:
    """event_type, start timestamp, n long, total double of events(event_type, ts, value) in each window.

    Events that come more than `late` after the newest one are left out, and so is the state of windows that
    no such event can change.
    """
    seen = events.withWatermark("ts", late).groupBy("event_type", F.window("ts", every))
    return seen.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("event_type", F.col("window.start").alias("start"), "n", "total")


def keep_latest(changes: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Writes every window's latest totals to folder, each batch's changes under its number; runs until the stream has no more.

    A batch that comes again writes the same files. latest() of the folder's rows are the totals.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(written: DataFrame) -> DataFrame:
    """Of what keep_latest() wrote, the last batch's row of each window."""
    row = F.max_by(F.struct("n", "total"), "batch").alias("row")
    return written.groupBy("event_type", "start").agg(row).select("event_type", "start", "row.n", "row.total")
