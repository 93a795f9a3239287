"""Tables that cut lineage: written to the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Spark then deletes a query's shuffle files at its end, and not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only where that is unset (single machine, tests) one of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="framewright-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/framewright/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write a table to the shared folder and read it back; executors lost later cost nothing."""
    path, spark = new_path(df.sparkSession, name), df.sparkSession
    was = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")  # nothing reads the shuffles of a table that is written
    try:
        # most columns are hashes: dictionaries and high levels only cost time
        df.write.option("compression", codec).option("parquet.enable.dictionary", "false").option("parquet.compression.codec.zstd.level", "1").parquet(path)
    finally:
        spark.conf.set(CLEANUP, was)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._framewright_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table of ``stored`` that nothing reads any more."""
    spark, path = df.sparkSession, df._framewright_path
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
