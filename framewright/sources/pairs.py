"""Pair datasets: one JSON array per file, their subsets, and their sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAIR = (
    "id string, fixture string, mutationId string, kind string, magnitude string, selector string, description string, before string, after string, "
    "domBefore string, domAfter string, groundTruthRect struct<x:double,y:double,w:double,h:double>"
)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAIR).option("multiLine", True).json(path)


def write_pairs(pairs: DataFrame, path: str) -> None:
    pairs.write.mode("overwrite").json(path)


def subset(pairs: DataFrame, ids: list[str]) -> DataFrame:
    """The pairs of a list in its order, as ``place``; a missing one is an error when rows are read."""
    wanted = pairs.sparkSession.createDataFrame(list(enumerate(ids)), "place int, id string")
    found = F.broadcast(wanted).join(pairs.withColumn("__known", F.lit(True)), "id", "left")
    message = F.concat(F.lit("no such pair: "), F.col("id"))
    return found.where(F.coalesce("__known", F.raise_error(message).cast("boolean"))).drop("__known")


def subset_if_present(pairs: DataFrame, ids: list[str]) -> DataFrame:
    """The pairs of a list that there are."""
    wanted = pairs.sparkSession.createDataFrame([(i,) for i in ids], "id string")
    return pairs.join(F.broadcast(wanted), "id", "left_semi")
