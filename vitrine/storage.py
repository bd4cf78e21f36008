"""Tables written to the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; without it a new temporary folder, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
    return tempfile.mkdtemp(prefix="spark-")


def save(df: DataFrame, tag: str) -> DataFrame:
    """The table written and read back: later steps start from its files, whatever executors are lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "snappy").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
