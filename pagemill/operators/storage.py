"""Tables between phases, in a folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir where it is set, else a folder under the warehouse."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    return at.rstrip("/") if at else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_pagemill"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df and read it back; its lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
