"""Token prices and what runs cost and save."""

from __future__ import annotations

import json
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def price_overrides(text: str | None) -> list[tuple[str, float, float]]:
    """Rows (model, per_input, per_output) of a JSON object of prices a million tokens; a broken one is warned of and ignored."""
    if not text:
        return []
    try:
        return [(m, float(p["inputPerMillion"]), float(p["outputPerMillion"])) for m, p in json.loads(text).items()]
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        warnings.warn(f"price overrides ignored: {e}", stacklevel=2)
        return []


def pricing(spark: SparkSession, table: list[tuple[str, float, float]], overrides: list[tuple[str, float, float]] = ()) -> DataFrame:
    """model, per_input, per_output: a model's override replaces its whole row."""
    rows = {m: (m, i, o) for m, i, o in [*table, *overrides]}
    return spark.createDataFrame(list(rows.values()), "model string, per_input double, per_output double")


def usage_cost(input_tokens: Column, output_tokens: Column) -> Column:
    return input_tokens / F.lit(1e6) * F.col("per_input") + output_tokens / F.lit(1e6) * F.col("per_output")


def with_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Rows of (model, input_tokens, output_tokens) with cost_usd, 0 of unknown models; prices are a handful of rows."""
    cost = F.coalesce(usage_cost(F.col("input_tokens"), F.col("output_tokens")), F.lit(0.0))
    return usage.join(F.broadcast(prices), "model", "left").withColumn("cost_usd", cost).drop("per_input", "per_output")


def run_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Tokens and cost of each model's run, to 4 decimals, halves up."""
    sums = usage.groupBy("model").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    return with_cost(sums, prices).withColumn("cost_usd", F.floor(F.col("cost_usd") * 10000 + 0.5) / 10000)


def report_summary(pairs: DataFrame, results: DataFrame, prices: DataFrame) -> DataFrame:
    """changed and unchanged results, cache hits and misses, cost of all but hits, and what the hits saved.

    A result without a pair counts as changed; savings are the mean cost of a miss for each hit, 0 unless there are both.
    """
    r = with_cost(results, prices).join(pairs.select(F.col("id").alias("pair_id"), "kind"), "pair_id", "left")
    none = F.col("kind").eqNullSafe(F.lit("none"))
    counts = r.agg(
        F.count_if(~none).alias("changed_count"),
        F.count_if(none).alias("none_count"),
        F.count_if(F.col("cached")).alias("cache_hits"),
        F.count_if(~F.col("cached")).alias("cache_misses"),
        F.coalesce(F.sum(F.when(~F.coalesce("cached", F.lit(False)), F.col("cost_usd"))), F.lit(0.0)).alias("cost_usd"),
    )
    both = (F.col("cache_hits") > 0) & (F.col("cache_misses") > 0)
    return counts.withColumn("saved_usd", F.when(both, F.col("cost_usd") / F.col("cache_misses") * F.col("cache_hits")).otherwise(0.0))
