"""Intermediate tables in the folder that every executor reaches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's `spark.checkpoint.dir`, or the checkpoint folder of the Spark context."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and spark.sparkContext.getCheckpointDir() is not None:
        folder = spark.sparkContext.getCheckpointDir()
    if folder is None:
        raise ValueError("This operator writes intermediate tables. Set spark.checkpoint.dir to a "
                         "folder that every executor can reach.")
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: computed once, and safe from lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
