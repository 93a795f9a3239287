"""An extension: unchanged-pair suppression over a folder of pair files that keeps growing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.pairs import PAIR


def stream_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """New files of one JSON object a line, as they come."""
    return spark.readStream.schema(PAIR).option("maxFilesPerTrigger", 100).json(folder)


def candidates(pairs: DataFrame) -> DataFrame:
    """Pairs whose snapshots differ at all: only these need the full comparison."""
    return pairs.where(~F.col("domBefore").eqNullSafe(F.col("domAfter"))).select("id", "kind", "domBefore", "domAfter", "before", "after")
