"""Reports: one JSON document or HTML page per run, and the texts of its log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import data_uri, fixed, html_escape, percent
from .cost import with_cost


def metrics_json(metrics: DataFrame, summary: DataFrame) -> DataFrame:
    """One row ``report``: the metrics of every arm, by name, and the run's costs; arms are a handful of rows."""
    arms = metrics.agg(F.array_sort(F.collect_list(F.struct(*metrics.columns))).alias("arms"))
    return arms.crossJoin(summary.select(F.struct(*summary.columns).alias("summary"))).select(F.to_json(F.struct("arms", "summary")).alias("report"))


def pair_details(pairs: DataFrame, results: DataFrame) -> DataFrame:
    """(baseline, pair_id, detail): a JSON object for each result of a known pair, with nulls where there is no type or description.

    ``results`` may have ``classifications``, an array of structs, one for each classified region.
    """
    r = results.join(pairs.select(F.col("id").alias("pair_id"), "kind"), "pair_id")
    regions = F.coalesce("classifications", F.array()) if "classifications" in results.columns else F.array()
    fields = [F.col("pair_id").alias("id"), "kind", "changed", "change_type", "description", F.size(regions).alias("regions_classified"), regions.alias("classifications"), "input_tokens", "output_tokens"]
    return r.select("baseline", "pair_id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("detail"))


def run_document(metrics: DataFrame, details: DataFrame, totals: DataFrame) -> DataFrame:
    """(place, baseline, pair_id, line): one JSON document of a run, line by line, in the order of the first three.

    {"arms": [{"baseline": ..., "metrics": {...}, "perPair": [...]}, ...], "totals": {...}}, with arms by name, and pairs by id.  ``metrics`` has a row for
    each arm and ``details`` JSON texts (baseline, pair_id, detail), as ``pair_details`` gives them; an arm of which
    there are no details has an empty list, details of an unknown arm are left out.  Arms are a handful of rows;
    a pair is a line, and none is gathered with others.
    """
    arms = metrics.select("baseline", F.to_json(F.struct(*(c for c in metrics.columns if c != "baseline"))).alias("metrics"))
    first_arm = metrics.agg(F.min("baseline").alias("first_arm"))
    head = arms.crossJoin(F.broadcast(first_arm)).select(  # one row
        F.lit(1).alias("place"), "baseline", F.lit(None).cast("bigint").alias("pair_id"),
        F.concat(F.when(F.col("baseline") == F.col("first_arm"), "").otherwise("]},"), F.lit('{"baseline":'), _quoted("baseline"), F.lit(',"metrics":'), "metrics", F.lit(',"perPair":[')).alias("line"),
    )
    first = details.groupBy("baseline").agg(F.min("pair_id").alias("first"))
    known = details.join(F.broadcast(arms.select("baseline")), "baseline", "left_semi").join(F.broadcast(first), "baseline")
    pairs = known.select(F.lit(1).alias("place"), "baseline", "pair_id", F.concat(F.when(F.col("pair_id") == F.col("first"), "").otherwise(","), "detail").alias("line"))
    none = [F.lit(None).cast("string").alias("baseline"), F.lit(None).cast("bigint").alias("pair_id")]
    closing = F.when(F.col("first_arm").isNull(), "").otherwise("]}")
    top = first_arm.select(F.lit(0).alias("place"), *none, F.lit('{"arms":[').alias("line"))
    end = totals.crossJoin(F.broadcast(first_arm)).select(F.lit(2).alias("place"), *none, F.concat(closing, F.lit('],"totals":'), F.to_json(F.struct(*totals.columns)), F.lit("}")).alias("line"))  # one row
    return top.unionByName(head).unionByName(pairs).unionByName(end)


def _quoted(column: str) -> Column:
    """A text as JSON."""
    return F.regexp_extract(F.to_json(F.struct(F.col(column).alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)


def write_document(lines: DataFrame, folder: str) -> None:
    """The document as text files of one folder, whose parts in the order of their names are the document."""
    order = ["place", "baseline", "pair_id"]
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.mode("overwrite").text(folder)


def run_totals(results: DataFrame, prices: DataFrame) -> DataFrame:
    """One row: pairs, results, tokens in and out of all arms, and their cost to 4 decimals, halves up."""
    sums = with_cost(results, prices).agg(
        F.countDistinct("pair_id").alias("total_pairs"), F.count("*").alias("total_results"), F.sum("input_tokens").alias("total_input"), F.sum("output_tokens").alias("total_output"), F.sum("cost_usd").alias("cost_usd")
    )
    return sums.withColumn("cost_usd", F.floor(F.col("cost_usd") * 10000 + 0.5) / 10000)


def metric_lines(metrics: DataFrame) -> DataFrame:
    """A line of text for each arm."""
    rates = [F.concat(F.lit(f"{c} "), percent(F.col(c))) for c in ("recall", "region_precision", "false_positive_rate", "type_accuracy")]
    return metrics.select("baseline", F.concat_ws(", ", *rates, F.concat(F.lit("tokens "), fixed(F.col("avg_input_tokens"), 0))).alias("line"))


def html_rows(results: DataFrame, pairs: DataFrame, images: DataFrame) -> DataFrame:
    """A table row of HTML for each result of a known pair."""
    r = results.join(pairs.select(F.col("id").alias("pair_id"), "kind"), "pair_id").join(images.select("pair_id", "before", "after"), "pair_id", "left")
    cells = [html_escape(F.col("pair_id").cast("string")), html_escape(F.col("kind")), html_escape(F.coalesce("change_type", F.lit("-"))), html_escape(F.coalesce("description", F.lit("")))]
    shots = [F.coalesce(F.concat(F.lit('<img src="'), data_uri(F.col(c)), F.lit('">')), F.lit("")) for c in ("before", "after")]
    row = F.concat(F.lit("<tr><td>"), F.concat_ws("</td><td>", *cells, *shots), F.lit("</td></tr>"))
    return r.select("pair_id", row.alias("row"))


def write_html(rows: DataFrame, title: str, folder: str) -> None:
    """The page as text files of one folder: a head, the rows in order of pairs, an end."""
    spark = rows.sparkSession
    head = spark.createDataFrame([(0, "", f"<!doctype html><meta charset=utf-8><title>{title}</title><table>"), (2, "", "</table>")], "place int, pair string, value string")
    body = rows.select(F.lit(1).alias("place"), F.col("pair_id").cast("string").alias("pair"), F.col("row").alias("value"))
    head.unionByName(body).repartitionByRange("place", "pair").sortWithinPartitions("place", "pair").select("value").write.mode("overwrite").text(folder)
