"""Resumable scoring of chunk files: a file stream with a checkpoint, run until it has caught up.

There is no event time here; the checkpoint is the durable offset, so a stopped run goes on with the chunks it hasn't done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def score_available(spark: SparkSession, source: str, schema: str, transform: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, files_at_once: int = 16) -> None:
    """Reads new Parquet chunks, applies a transformation without state and appends the result."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(source)
    query = transform(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
