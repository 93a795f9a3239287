"""Reading the tables, and the session settings that the operators need."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts may be long: few rows and bytes to an Arrow batch keep Python workers small.
ARROW_ROWS, ARROW_BYTES = "1000", "4m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of up to ``rows`` rows for what is run inside: for narrow rows of numbers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        yield
    finally:
        bounded_batches(spark)


def as_rows(df: DataFrame) -> DataFrame:
    """One column ``row`` of all columns: tasks take columns of any names that way, dotted ones as well."""
    return df.select(F.struct("*").alias("row"))


def whole_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns of ``as_rows``, batch by batch."""
    for batch in batches:
        yield pa.RecordBatch.from_struct_array(batch.column("row"))
