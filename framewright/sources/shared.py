"""Tables in the folder that the whole cluster shares: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_path(spark: SparkSession, name: str) -> str:
    """A new place under ``spark.checkpoint.dir``; only where that is unset (one machine, tests) under a folder of our own."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        top = "file://" + tempfile.mkdtemp(prefix="framewright-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/framewright/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written as Parquet and read again."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
