"""Tables in the folder that all executors share, for results that a plan reads more than once and must not see change."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, /tmp/checkpoints for a local master and the warehouse for a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return "/tmp/checkpoints"
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if warehouse.startswith("file:") or ":" not in warehouse:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{warehouse}/_checkpoints"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df``, written once and read back. Expire the folder's tables with the folder."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
