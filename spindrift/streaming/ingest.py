"""Documents as a stream into a chunk store: each micro-batch replaces whole sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spindrift.functions import embedding
from spindrift.operators import chunking
from spindrift.sources import markdown
from spindrift.sources.chunk_store import ChunkStore


def stream_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """Files of folder/*.md as they arrive: text, fallback."""
    files = spark.readStream.option("pathGlobFilter", "*.md").option("wholetext", True).schema("value string").format("text").load(folder)
    return files.select(markdown.stem().alias("fallback"), F.col("value").alias("text"))


def ingest(documents: DataFrame, store: ChunkStore, checkpoint: str, embed: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Writes chunks of a stream of documents to a store, once each; runs until the stream has no more.

    A batch is chunked and embedded once, and all its sources are replaced in one atomic write. One that
    comes again after a failure replaces the same sources by the same chunks.
    """
    embed = embed or (lambda df: embedding.hashed(df, "embedding_text", dimension=store.dimension))

    def write(batch: DataFrame, _: int) -> None:
        good = batch.where("error is null").drop("error")
        store.replace_sources(good, embed(chunking.chunks(good)))

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
