"""Tables written once for plans that read them many times."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_FOLDER = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; without it a local one, where there is no cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or LOCAL_FOLDER


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table of its own in the shared folder: lineage ends there, filters and columns are still pushed into it."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
