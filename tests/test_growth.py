"""What keeps shuffles, writes and calls in proportion to the input: inputs dealt out once, small pairs answered whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.operators import cache, fusion, raster
from framewright.plans import registry, runs
from framewright.plans.inputs import of
from framewright.streaming import replay as stream

BOX = "pair_id long, ord long, x long, y long, w long, h long, changed_pixels long"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_snapshots_are_dealt_out_once(spark, sf_dir):
    """Both sides lie by pair, dealt out as raw rows that have nothing derived in them, and are not dealt out again."""
    plan = plan_of(registry.dom_diff(spark, sf_dir))
    assert "hashpartitioning(pair_id" not in plan and plan.count("Exchange hashpartitioning(l_orderkey") == 2
    for line, below in zip(plan.split("\n"), plan.split("\n")[1:], strict=False):
        assert "hashpartitioning" not in line or "FileScan" in below


@pytest.mark.parametrize("whole", [0, 40, 4096])
def test_pairs_are_merged_whole_or_by_cells(spark, whole):
    rng = np.random.default_rng(5)
    rows, want = [], []
    for pair, (n, far) in enumerate(((1, 9), (30, 900), (40, 200), (41, 2500), (90, 4000))):
        boxes = np.c_[rng.integers(0, far, (n, 2)), rng.integers(0, 1500, n), rng.integers(0, 90, n), rng.integers(1, 9, n)]
        rows += [(pair, i, *map(int, b)) for i, b in enumerate(boxes)]
        want += [(pair, *map(int, b)) for b in raster.merge_boxes(boxes)]
    df = spark.createDataFrame([*rows, (None, 0, 1, 1, 1, 1, 1)], BOX)
    out = raster.merged_regions(df, whole=whole).collect()
    assert sorted((r.pair_id, r.x, r.y, r.w, r.h, r.changed_pixels) for r in out) == sorted(want)
    for r in out:
        assert r.ord == min(i for p, i, x, y, w, h, _ in rows if p == r.pair_id and r.x <= x and r.y <= y and x + w <= r.x + r.w and y + h <= r.y + r.h)


def test_boxes_that_lie_by_pair_are_not_dealt_out_again(spark, sf_dir):
    assert plan_of(raster.merged_regions(of(spark, sf_dir, "boxes"))).count("Exchange") == 1


@pytest.mark.parametrize("whole", [0, 12, 1024])
def test_pairs_are_fused_whole_or_by_cells(spark, whole):
    """Null pairs and rectangles among them; pair 3 has pixel regions only, pair 4 changes only."""
    rng = np.random.default_rng(11)
    draw = lambda pair, n: [(pair, i, *(float(v) for v in rng.integers(0, 500, 2)), *(float(v) for v in rng.integers(0, 60, 2))) for i in range(n)]
    dom = [*draw(1, 12), *draw(2, 30), *draw(4, 2), *draw(None, 15), (1, 98, None, 0.0, 5.0, 5.0)]
    pix = [*draw(1, 9), *draw(2, 13), *draw(3, 14), *draw(None, 4), (1, 99, 0.0, None, 500.0, 5.0)]
    schema = "pair_id long, ord long, x double, y double, w double, h double"
    changes = spark.createDataFrame(dom, schema).withColumn("changed_fields", F.array(F.lit("rect"))).withColumn("id", F.concat(F.lit("n"), "ord"))
    meet = lambda p, q: p[0] is not None and p[0] == q[0] and None not in (*p, *q) and all(p[i] < q[i] + q[i + 2] and q[i] < p[i] + p[i + 2] for i in (2, 3))
    want = [(p[0], p[1], "dom+pixel" if any(meet(p, q) for q in pix) else "dom", f"n{p[1]}") for p in dom]
    want += [(q[0], q[1] + fusion.PIXEL_FIRST, "pixel", None) for q in pix if q[0] in (1, 2, 4) and not any(meet(p, q) for p in dom)]
    got = fusion.candidate_regions(changes, spark.createDataFrame(pix, schema), whole)
    assert sorted(((r.pair_id, r.ord, r.source, r.dom_id) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert got.where("w < 1 or h < 1").isEmpty() and got.columns == ["pair_id", "ord", "x", "y", "w", "h", "source", "changed_fields", "dom_id"]


def test_small_pairs_are_fused_with_two_shuffles(spark, sf_dir):
    """Changes are dealt out by pair once; pixel regions lie by pair already."""
    plan = plan_of(registry.fusion_sources(spark, sf_dir))
    assert plan.count("Exchange hashpartitioning(l_orderkey") == 1 and plan.count("Exchange hashpartitioning(pair_id") == 1


def test_images_of_a_small_file_are_spread(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(runs, "PAIRS", 4)
    pairs = spark.read.parquet(f"{sf_dir}/supplier.parquet").count()
    assert f"RoundRobinPartitioning({pairs // 4 + 1})" in plan_of(runs.smoothed_edges(spark, sf_dir))


def test_a_stream_calls_a_bucket_and_not_a_key(spark, tmp_path, monkeypatch):
    """2,000 keys in 3 buckets: the rows of a bucket are answered at once, as those of a table are."""
    monkeypatch.setattr(stream, "BUCKETS", 3)
    log = spark.range(6000).select("id", F.concat(F.lit("k"), F.col("id") % 2000).alias("key"), F.timestamp_seconds(F.lit(1_700_000_000) + F.floor(F.col("id") / 2000) * 4).alias("at"))
    for k in range(2):
        log.where(F.floor(F.col("id") / 3000) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    requests = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream.replayed(requests, str(tmp_path), 5000)
    hits = sorted((r.id, r.hit) for r in spark.read.parquet(str(tmp_path / "hits")).collect())
    assert hits == sorted((r.id, r.hit) for r in cache.replay(log, 5000).collect()) and sum(h for _, h in hits) == 2000
