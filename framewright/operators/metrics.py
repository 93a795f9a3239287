"""Scores of predictions against the truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import HIT


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _struct_iou(p: Column, t: Column) -> Column:
    wide = F.least(p["x"] + p["w"], t["x"] + t["w"]) - F.greatest(p["x"], t["x"])
    tall = F.least(p["y"] + p["h"], t["y"] + t["h"]) - F.greatest(p["y"], t["y"])
    shared = F.greatest(wide, F.lit(0.0)) * F.greatest(tall, F.lit(0.0))
    union = p["w"] * p["h"] + t["w"] * t["h"] - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def summarize(pairs: DataFrame, results: DataFrame) -> DataFrame:
    """One row per baseline: n, recall, region_precision, false_positive_rate, type_accuracy, end_to_end_accuracy, average tokens.

    ``pairs`` has id, kind and truth (a rectangle or null); ``results`` has pair_id, baseline, changed, regions,
    change_type, input_tokens, output_tokens.  Results without a pair count in n and in the tokens' denominator
    only; no rate is null; an empty table gives one row of the baseline ``unknown``.
    """
    r = results.join(pairs.select(F.col("id").alias("pair_id"), "kind", "truth", F.lit(True).alias("matched")), "pair_id", "left")
    real = F.col("matched") & (F.col("kind") != "none")
    none = F.col("matched") & (F.col("kind") == "none")
    found = real & F.col("changed")
    hit = found & F.col("truth").isNotNull() & F.exists("regions", lambda p: _struct_iou(p, F.col("truth")) >= HIT)
    typed = found & F.col("change_type").isNotNull()
    right = typed & (F.col("change_type") == F.col("kind"))
    counts = {"n": F.count("*"), "real": F.count_if(real), "none": F.count_if(none), "tp": F.count_if(found), "fp": F.count_if(none & F.col("changed")), "hit": F.count_if(hit), "typed": F.count_if(typed), "correct": F.count_if(right)}
    tokens = {f"sum_{c}": F.coalesce(F.sum(F.when(F.col("matched"), F.col(c))), F.lit(0)) for c in ("input_tokens", "output_tokens")}
    grouped = r.groupBy("baseline").agg(*(v.alias(k) for k, v in (counts | tokens).items()))
    nothing = results.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("unknown").alias("baseline"), *(F.lit(0).alias(k) for k in (counts | tokens)))
    grouped = grouped.unionByName(nothing)
    c = F.col
    return grouped.select(
        "baseline",
        "n",
        ratio(c("tp"), c("real")).alias("recall"),
        ratio(c("hit"), c("tp")).alias("region_precision"),
        ratio(c("fp"), c("none")).alias("false_positive_rate"),
        ratio(c("correct"), c("typed")).alias("type_accuracy"),
        ratio(c("correct"), c("real")).alias("end_to_end_accuracy"),
        ratio(c("sum_input_tokens"), c("n")).alias("avg_input_tokens"),
        ratio(c("sum_output_tokens"), c("n")).alias("avg_output_tokens"),
    )


def average_score(scores: DataFrame) -> DataFrame:
    """Mean score; 0 of none."""
    return scores.agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("average_score"), F.count("*").alias("n"))


def status(real: Column, changed: Column, right: Column) -> Column:
    """The word that the run's log has for a pair."""
    return (
        F.when(~real & changed, "false positive")
        .when(~real, "ok")
        .when(changed & right, "detected, right type")
        .when(changed, "detected, wrong type")
        .otherwise("missed")
    )


def strict_hit(a: Column, b: Column) -> Column:
    """Whether two rectangle structs overlap by more than the IoU of a hit, not by just as much."""
    return _struct_iou(a, b) > HIT


def tallies(pairs: DataFrame) -> DataFrame:
    """One row of (expected, detected): total, expected, detected, false_positives, recall, false_positive_rate; 0 where nothing was expected."""
    counts = pairs.agg(
        F.count("*").alias("total"),
        F.count_if("expected").alias("expected"),
        F.count_if("detected").alias("detected"),
        F.count_if(F.col("detected") & ~F.col("expected")).alias("false_positives"),
    )
    quiet = F.col("total") - F.col("expected")
    return counts.select("*", ratio(F.col("detected"), F.col("expected")).alias("recall"), ratio(F.col("false_positives"), quiet).alias("false_positive_rate"))


def matched(results: DataFrame, pairs: DataFrame) -> DataFrame:
    """Results with their pair's columns; a result of no pair is an error when rows are read."""
    known = pairs.withColumnRenamed("id", "pair_id").withColumn("__known", F.lit(True))
    message = F.raise_error(F.concat(F.lit("no such pair: "), F.coalesce(F.col("pair_id").cast("string"), F.lit("null")))).cast("boolean")
    return results.join(known, "pair_id", "left").where(F.coalesce("__known", message)).drop("__known")


def pair_usage(regions: DataFrame) -> DataFrame:
    """Tokens of each pair, and cached: whether all its regions were, null where none says."""
    return regions.groupBy("pair_id").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.bool_and("cached").alias("cached"))
