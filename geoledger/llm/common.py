"""Helpers that the training-data operators share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import scratch, written  # noqa: F401

#: Rows and bytes of one Arrow batch: what a Python worker holds at once.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: Rows that a Parquet reader holds decoded at once.
READ_ROWS = 512


def tune(spark: SparkSession) -> SparkSession:
    """Bounds the batches of rows that tasks hold, so that long texts fill neither a Python worker nor an executor."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The column as UTF-8 bytes; null is empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column as str; null is empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def empty_text(name: str = "text"):
    return F.coalesce(F.col(name), F.lit("")).alias(name)
