"""Whole runs: nested documents, answers that are asked once, arms from screenshots on, smoothed rims."""

import json

import numpy as np
from pyspark.sql import functions as F

from framewright.operators import classify, metrics, raster, report
from framewright.plans import registry, runs
from framewright.sources import png

DETAIL = "baseline string, pair_id long, detail string"


def test_a_run_is_one_json_document(spark, tmp_path):
    scores = spark.createDataFrame([("a", 2, 0.5), ('b "x"', 1, 1.0), ("idle", 0, 0.0)], "baseline string, n long, recall double")
    details = spark.createDataFrame([("a", 10, '{"id":10}'), ("a", 9, '{"id":9}'), ('b "x"', 1, '{"id":1}'), ("gone", 1, "{}")], DETAIL)
    totals = spark.createDataFrame([(3, 0.25)], "n long, cost double")
    lines = report.run_document(scores, details, totals)
    report.write_document(lines, str(tmp_path / "run"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "run").glob("part-*")))
    assert json.loads(text) == {
        "arms": [
            {"baseline": "a", "metrics": {"n": 2, "recall": 0.5}, "perPair": [{"id": 9}, {"id": 10}]},
            {"baseline": 'b "x"', "metrics": {"n": 1, "recall": 1.0}, "perPair": [{"id": 1}]},
            {"baseline": "idle", "metrics": {"n": 0, "recall": 0.0}, "perPair": []},
        ],
        "totals": {"n": 3, "cost": 0.25},
    }
    nothing = report.run_document(scores.limit(0), details, totals).orderBy("place", "baseline", "pair_id").collect()
    assert json.loads("".join(r.line for r in nothing)) == {"arms": [], "totals": {"n": 3, "cost": 0.25}}


def test_the_run_query_is_valid_json(spark, sf_dir):
    lines = runs.run_document(spark, sf_dir).orderBy("place", F.col("baseline").asc_nulls_first(), F.col("pair_id").asc_nulls_first()).collect()
    run = json.loads("".join(r.line for r in lines))
    pairs = [p for a in run["arms"] for p in a["perPair"]]
    assert len(pairs) == len(lines) - 2 - len(run["arms"]) and {len(p["classifications"]) for p in pairs} == {0, 1, 2, 3}
    assert {p["description"] is None for p in pairs} == {True, False} and all(p["regions_classified"] == len(p["classifications"]) for p in pairs)


class Counting:
    """Answers, and notes each call in a file of a folder."""

    def __init__(self, folder):
        self.folder = folder

    def send(self, system, blocks):
        import uuid

        (self.folder / uuid.uuid4().hex).touch()
        return '{"changeType":"other"}', 7, 3


def test_a_key_is_asked_once_however_often_answers_are_read(spark, tmp_path):
    white, black = np.full((30, 30, 4), 255, np.uint8), np.zeros((30, 30, 4), np.uint8)
    images = spark.createDataFrame([(i, png.encode_png(white), png.encode_png(black)) for i in range(6)], "pair_id long, before binary, after binary")
    regions = spark.createDataFrame([(i, 0, 1.0, 1.0, 5.0, 5.0, "dom", ["rect"], "n" if i < 4 else "m") for i in range(6)], "pair_id long, ord long, x double, y double, w double, h double, source string, changed_fields array<string>, dom_id string")
    none = spark.createDataFrame([], "key string, classification struct<change_type:string,description:string,confidence:double>, cached_at timestamp")
    answered, fresh = classify.classify_regions(regions, images, none, lambda: Counting(tmp_path), F.current_timestamp())
    for _ in range(2):
        assert {r.pair_id: (r.change_type, r.cached, r.input_tokens) for r in answered.collect()} == {i: ("other", False, 7) for i in range(6)}
        assert fresh.count() == 2
    assert len(list(tmp_path.iterdir())) == 2
    again, none_left = classify.classify_regions(regions, images, fresh, lambda: Counting(tmp_path), F.current_timestamp())
    assert {r.cached for r in again.collect()} == {True} and none_left.count() == 0 and len(list(tmp_path.iterdir())) == 2


def test_classification_paints_cuts_and_asks_once(spark, sf_dir):
    plan = registry.region_classification(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan  # crops and answers are read from tables


def test_rims_are_left_out(spark, sf_dir):
    """The rule leaves out pixels of the moving rim, and keeps the box."""
    from framewright.plans.runs import smoothed_edges

    kept = {(r.pair_id, r.x, r.y) for r in smoothed_edges(spark, sf_dir).collect()}
    boxes = {(k, x, y) for k, x, y in kept if k % 2 == 0 and 15 <= x < 19 and 4 <= y < 8}
    keys = [r.s_suppkey for r in spark.read.parquet(f"{sf_dir}/supplier.parquet").collect()]
    assert len(boxes) == 16 * sum(k % 2 == 0 for k in keys)
    y, x = np.mgrid[0:16, 0:24]
    grey = lambda s: np.where(s < 0, 30, np.where(s < 2, 120, 220))
    moved = sum(int((np.abs(grey(2 * x + 3 * y - 20 - k % 17) - grey(2 * x + 3 * y - 20 - k % 17 - k % 3)) > 60).sum()) for k in keys)
    assert 0 < len(kept - boxes) < moved - len(keys), (len(kept - boxes), moved)


def test_changed_pixels_feed_components(spark):
    a = np.full((20, 20, 4), 255, np.uint8)
    b = a.copy()
    b[2:5, 3:9, :3] = 0
    images = spark.createDataFrame([(1, png.encode_png(a), png.encode_png(b)), (2, png.encode_png(a), png.encode_png(a))], "pair_id long, before binary, after binary")
    assert [(r.pair_id, r.x, r.y, r.w, r.h, r.changed_pixels) for r in raster.mask_components(raster.changed_pixels(images), 4).collect()] == [(1, 3, 2, 6, 3, 18)]


def test_summaries_build_no_job(spark, sf_dir):
    r = "pair_id string, baseline string, changed boolean, regions array<struct<x:double,y:double,w:double,h:double>>, change_type string, input_tokens long, output_tokens long"
    pairs = spark.createDataFrame([("a", "text-change", (0.0, 0.0, 4.0, 4.0))], "id string, kind string, truth struct<x:double,y:double,w:double,h:double>")
    hits = [(0.0, 0.0, 4.0, 4.0), (90.0, 0.0, 4.0, 4.0)]
    rows = [("a", "all", True, hits, None, 1, 1), ("a", "late", True, hits[::-1], None, 1, 1), ("a", "far", True, hits[1:], None, 1, 1), ("a", "none", True, [], None, 1, 1)]
    got = {x.baseline: x.region_precision for x in metrics.summarize(pairs, spark.createDataFrame(rows, r)).collect()}
    assert got == {"all": 1.0, "late": 1.0, "far": 0.0, "none": 0.0}
