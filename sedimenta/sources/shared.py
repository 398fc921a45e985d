"""Tables in the folder that the driver and all executors share (spark.checkpoint.dir)."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = os.path.join(tempfile.gettempdir(), f"sedimenta-{os.getuid()}")  # a single machine, as in tests
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written and read back: the plan is cut, and a lost executor costs no more than a read."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
