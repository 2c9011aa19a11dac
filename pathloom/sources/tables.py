"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL = "pathloom.core.scratch.dir"


def shared(spark: SparkSession, label: str) -> str:
    """A new path under ``spark.checkpoint.dir``.  A local master without that
    setting uses a temporary folder of the session; others raise."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = spark.conf.get(_LOCAL, None) or "file://" + tempfile.mkdtemp(prefix="pathloom-")
        spark.conf.set(_LOCAL, folder)
    return f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df``, written as Parquet to the shared folder and read back: a lost
    executor costs a read, not the lineage."""
    path = shared(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
