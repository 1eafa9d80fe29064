"""The folder that driver and executors share, and tables written there to cut a lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: What a task's writer holds of a table before it goes to the file.
ROW_GROUP_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or where that is unset and the master is local, as in tests, a folder of our own: executors on other
    machines don't see it. Clear the application's folder after the job."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not given:
        if not (spark.sparkContext.master or "").partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
        given = f"/tmp/geoledger-{spark.sparkContext.applicationId}"
        spark.sparkContext.setCheckpointDir(given)
    return f"{given.rstrip('/')}/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and rereads it: cuts the lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
