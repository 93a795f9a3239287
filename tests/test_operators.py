"""Small cases of every operator, each with its result."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.functions import geometry as geo
from framewright.functions import replies, text
from framewright.functions.geometry import Rect
from framewright.operators import cache, classify, cost, domdiff, fusion, metrics, mutate, raster, report
from framewright.plans import config
from framewright.sources import html_dom, pairs, png

NODE = "pair_id bigint, ord bigint, path string, id string, text string, x double, y double, w double, h double, color string, background_color string, font_weight string, border_radius string"


def node(ord_=0, path="DIV:0", text_="hello", x=10.0, bg="white", id_="x", w=100.0):
    return (1, ord_, path, id_, text_, x, 0.0, w, 20.0, "black", bg, "400", "0px")


@pytest.mark.parametrize(
    ("before", "after", "fields"),
    [
        ([node()], [node()], []),
        ([node()], [node(x=10.4)], []),
        ([node()], [node(x=11.0)], []),
        ([node()], [node(x=12.0)], ["rect"]),
        ([node()], [node(x=16.0)], ["rect"]),
        ([node()], [node(text_="world")], ["text"]),
        ([node()], [node(bg="red")], ["backgroundColor"]),
        ([], [node()], ["added"]),
        ([node()], [], ["removed"]),
        ([node()], [node(text_="world", x=30.0)], ["rect", "text"]),
        ([node(), node(1, text_="late")], [node(text_="late")], []),
        ([node()], [node(id_="other")], []),
    ],
)
def test_dom_diff(spark, before, after, fields):
    out = domdiff.dom_diff(spark.createDataFrame(before, NODE), spark.createDataFrame(after, NODE)).collect()
    assert [r.changed_fields for r in out] == ([fields] if fields else [])


def test_snapshots_are_parsed_in_order(spark):
    dom = json.dumps([{"path": p, "tag": "P", "id": "", "className": "c", "text": "t", "rect": {"x": 1, "y": 2, "w": 3, "h": 4}, "style": {"color": "red", "backgroundColor": "b", "fontWeight": "1", "borderRadius": "2"}} for p in ("P:0", "P:1")])
    out = domdiff.parse_snapshot(spark.createDataFrame([(1, dom), (2, "[]"), (3, None)], "pair_id long, dom string"), "dom").orderBy("ord").collect()
    assert [(r.ord, r.path, r.x, r.border_radius) for r in out] == [(0, "P:0", 1.0, "2"), (1, "P:1", 1.0, "2")]


def white(size, *patches):
    out = np.full((size, size, 4), 255, np.uint8)
    for x, y, w, h in patches:
        out[y : y + h, x : x + w] = (255, 0, 0, 255)
    return out


@pytest.mark.parametrize(("size", "patches", "boxes"), [(50, [], []), (60, [(10, 10, 20, 15)], [[10, 10, 20, 15, 300]]), (100, [(5, 5, 15, 15), (70, 70, 20, 20)], [[5, 5, 15, 15, 225], [70, 70, 20, 20, 400]]), (200, [(5, 5, 2, 2)], [])])
def test_pixel_regions(size, patches, boxes):
    mask = raster.change_mask(white(size), white(size, *patches))
    assert raster.image_regions(mask).tolist() == boxes


def test_sizes_must_agree():
    with pytest.raises(ValueError):
        raster.change_mask(white(3), white(4))


def test_components_do_not_wrap():
    assert len(raster.components(np.array([0, 1]), np.array([9, 0]))) == 2
    assert raster.components(np.array([0, 0, 0, 1, 2, 2]), np.array([0, 1, 2, 2, 0, 2])).tolist() == [[0, 0, 3, 3, 5], [0, 2, 1, 1, 1]]


def test_merging_reaches_a_fixpoint_in_any_order():
    rng = np.random.default_rng(0)
    for _ in range(50):
        boxes = np.c_[rng.integers(0, 120, (12, 2)), rng.integers(1, 20, (12, 2)), rng.integers(1, 9, 12)]
        one, two = raster.merge_boxes(boxes), raster.merge_boxes(boxes[::-1])
        assert sorted(one.tolist()) == sorted(two.tolist()) == sorted(raster.merge_boxes(one).tolist())
        assert one[:, 4].sum() == boxes[:, 4].sum()


def test_png_round_trip_and_filters():
    import zlib

    image = np.random.default_rng(1).integers(0, 256, (9, 7, 4), dtype=np.uint8)
    assert (png.decode_png(png.encode_png(image)) == image).all()
    rows, above = [], np.zeros(28, np.int64)
    for y, kind in enumerate([0, 1, 2, 3, 4, 4, 3, 2, 1]):
        line = image[y].reshape(-1).astype(np.int64)
        left, over = np.r_[np.zeros(4, np.int64), line[:-4]], np.r_[np.zeros(4, np.int64), above[:-4]]
        p = left + above - over
        near = np.stack((abs(p - left), abs(p - above), abs(p - over))).argmin(axis=0)
        guess = [0, left, above, (left + above) // 2, np.choose(near, (left, above, over))][kind]
        rows.append(bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes())
        above = line
    plain = png.encode_png(image)
    body = zlib.compress(b"".join(rows))
    chunk = len(body).to_bytes(4, "big") + b"IDAT" + body + zlib.crc32(b"IDAT" + body).to_bytes(4, "big")
    at = plain.index(b"IDAT") - 4
    assert (png.decode_png(plain[:at] + chunk + plain[plain.index(b"IEND") - 4 :]) == image).all()


def test_fusion(spark):
    images = spark.createDataFrame([(1, png.encode_png(white(80)), png.encode_png(white(80, (30, 0, 20, 20))))], "pair_id long, before binary, after binary")
    before = spark.createDataFrame([node(x=10.0, w=20.0), node(1, "DIV:1", x=60.0, w=5.0)], NODE)
    after = spark.createDataFrame([node(x=30.0, w=20.0), node(1, "DIV:1", x=60.0, w=5.0, bg="red")], NODE)
    regions, summary = fusion.detect(before, after, images)
    assert [r.source for r in regions.orderBy("ord").collect()] == ["dom+pixel", "dom"]
    assert summary.collect()[0].asDict() == {"pair_id": 1, "dom_change_count": 2, "changed": True, "pixel_region_count": 1}
    regions, summary = fusion.detect(before, before, images)
    assert regions.count() == 0 and summary.collect()[0].changed is False and summary.collect()[0].pixel_region_count == 1
    far = spark.createDataFrame([node(x=10.0, w=5.0, bg="red")], NODE)
    regions, _ = fusion.detect(spark.createDataFrame([node(x=10.0, w=5.0)], NODE), far, images)
    assert [r.source for r in regions.orderBy("ord").collect()] == ["dom", "pixel"]


REGION = "pair_id bigint, ord bigint, x int, y int, w int, h int"


def test_top_regions_keep_ties_in_order(spark):
    df = spark.createDataFrame([(1, i, 0, 0, s, s) for i, s in enumerate((5, 40, 10, 10))], REGION)
    assert [r.ord for r in fusion.top_regions(df).orderBy("rank").collect()] == [1, 2, 3, 0]
    assert fusion.top_regions(df, 2).count() == 2 and fusion.top_regions(df, 0).count() == 0


def test_pipeline_arm(spark):
    regions = spark.createDataFrame([(1, 0, 0, 0, 5, 5), (1, 1, 0, 0, 40, 40)], REGION)
    pair_ids = spark.createDataFrame([(1,), (2,)], "pair_id bigint")

    def answer(df):
        return df.select("*", F.concat(F.lit("t"), "ord").alias("change_type"), F.lit("d").alias("description"), F.lit(10).alias("input_tokens"), F.lit(5).alias("output_tokens"), (F.col("ord") == 0).alias("cached"))

    got = {r.pair_id: r for r in classify.pipeline_arm(pair_ids, regions, answer).collect()}
    assert (got[1].changed, got[1].change_type, got[1].input_tokens, got[1].cached, len(got[1].regions)) == (True, "t1", 20, False, 2)
    assert (got[2].changed, got[2].change_type, got[2].input_tokens, got[2].cached, got[2].regions) == (False, None, 0, None, [])
    got = {r.pair_id: r for r in classify.pipeline_arm(pair_ids, regions, answer, 0).collect()}
    assert got[1].changed and got[1].change_type is None and len(got[1].regions) == 2


class Echo:
    def send(self, system, blocks):
        assert [b["type"] for b in blocks] == ["text", "image", "text", "image"]
        return json.dumps({"changeType": system, "description": blocks[1]["mime"], "confidence": 1}), 7, 3


def test_crops_are_sent_and_replies_parsed(spark):
    images = spark.createDataFrame([(1, png.encode_png(white(100)), png.encode_png(white(100, (40, 40, 10, 10))))], "pair_id bigint, before binary, after binary")
    regions = spark.createDataFrame([(1, 0, 40, 40, 10, 10), (1, 1, 2, 2, 5, 5)], REGION).withColumn("prompt", F.lit("p"))
    out = classify.classified(classify.ask(classify.with_crops(regions, images), Echo)).orderBy("ord").collect()
    assert [png.decode_png(bytes(r.after_crop)).shape[:2] for r in out] == [(42, 42), (37, 37)]
    assert (out[0].change_type, out[0].description, out[0].confidence, out[0].input_tokens) == ("p", "image/png", 1.0, 7)


def test_requests_of_both_kinds():
    blocks = [classify.text_block("a"), classify.image_block(b"x")]
    assert classify.system_field_request("m", "s", blocks)["system"] == "s"
    assert classify.system_message_request("m", "s", blocks)["messages"][0] == {"role": "system", "content": "s"}
    assert classify.usage_of({}, "a", "b") == (0, 0)


@pytest.mark.parametrize(
    ("reply", "want"),
    [
        ('{"changeType":"color-change","description":"d","confidence":0.9}', ("color-change", "d", 0.9)),
        ('\n```JSON\n{"changeType":"x"}\n```\t', ("x", "", 0.0)),
        (" not json ", ("other", "not json", 0.0)),
        ('```\n{"changeType":"x"}\n```', ("other", '```\n{"changeType":"x"}\n```', 0.0)),
        ('{"changeType":"x"} junk', ("other", '{"changeType":"x"} junk', 0.0)),
        ('{"confidence":"0.9"}', ("other", "", 0.0)),
        ("null", ("other", "null", 0.0)),
        ("5", ("other", "", 0.0)),
        ("{'changeType':'x'}", ("other", "{'changeType':'x'}", 0.0)),
        ("NaN", ("other", "NaN", 0.0)),
        ('{"changeType":"a","changeType":"b"}', ("b", "", 0.0)),
    ],
)
def test_classifications(spark, reply, want):
    df = spark.createDataFrame([(reply,)], "reply string")
    assert tuple(classify.classified(df).drop("reply").first()) == want


def test_judgements(spark):
    texts = ['{"score":4}', '{"score":9}', '{"score":0}', "broken " * 30, '{"score":"4"}', '{"score":2.5,"rationale":"r"}']
    df = spark.createDataFrame([(i, t, "d") for i, t in enumerate(texts)] + [(9, "never sent", None), (10, "never sent", "")], "id int, reply string, description string")
    out = {r.id: (r.score, len(r.rationale)) for r in classify.judged(df, lambda d: d).collect()}
    assert {k: s for k, (s, _) in out.items()} == {0: 4, 1: 5, 2: 1, 3: 1, 4: 1, 5: 3, 9: 1, 10: 1} and out[3][1] == 100
    scores = spark.createDataFrame([(2,), (4,)], "score int")
    assert metrics.average_score(scores).first().average_score == 3 and metrics.average_score(scores.limit(0)).first().average_score == 0


def test_raw_verdicts(spark):
    texts = ['{"changed":"false","region":{"x":1,"y":2,"w":3,"h":4}}', '{"changed":""}', '{"changed":0}', "x", '{"changed":[],"type":"none"}']
    df = spark.createDataFrame([(t,) for t in texts], "reply string").withColumn("p", replies.parsed(F.col("reply")))
    out = df.select(*replies.raw_verdict(F.col("p"))).collect()
    assert [r.changed for r in out] == [True, False, False, False, True] and out[0].region.w == 3 and out[4].change_type == "none"


RESULT = "pair_id string, baseline string, changed boolean, regions array<struct<x:double,y:double,w:double,h:double>>, change_type string, description string, input_tokens bigint, output_tokens bigint, cached boolean, model string"
PAIRS = "id string, kind string, truth struct<x:double,y:double,w:double,h:double>"


def result(id_, changed=True, regions=((0.0, 0.0, 10.0, 10.0),), kind="text-change", tokens=(100, 20), cached=None, model="m"):
    return (id_, "arm", changed, list(regions), kind, None, *tokens, cached, model)


def test_metrics(spark):
    known = spark.createDataFrame([("a", "text-change", (0.0, 0.0, 10.0, 10.0)), ("b", "none", None)], PAIRS)

    def of(*rows):
        return metrics.summarize(known, spark.createDataFrame(list(rows), RESULT)).first()

    r = of(result("a"), result("b", False, (), None, (200, 40)))
    assert (r.recall, r.region_precision, r.false_positive_rate, r.type_accuracy, r.avg_input_tokens, r.avg_output_tokens) == (1, 1, 0, 1, 150, 30)
    r = of(result("a", False), result("b"))
    assert (r.recall, r.false_positive_rate, r.type_accuracy, r.end_to_end_accuracy) == (0, 1, 0, 0)
    r = of(result("a", regions=((50.0, 50.0, 5.0, 5.0),)))
    assert (r.recall, r.region_precision) == (1, 0)
    assert of(result("a", regions=((0.0, 0.0, 3.0, 10.0),))).region_precision == 1
    r = of(result("a"), result("unknown"))
    assert (r.n, r.avg_input_tokens, r.recall) == (2, 50, 1)
    r = metrics.summarize(known, spark.createDataFrame([], RESULT)).first()
    assert (r.baseline, r.n, r.recall, r.avg_input_tokens) == ("unknown", 0, 0, 0)
    assert "recall 0.0%" in report.metric_lines(metrics.summarize(known, spark.createDataFrame([], RESULT))).first().line


def test_costs(spark):
    prices = cost.pricing(spark, [("m", 3.0, 15.0)], cost.price_overrides('{"o":{"inputPerMillion":1,"outputPerMillion":2}}'))
    use = spark.createDataFrame([("m", 1_000_000, 1_000_000), ("o", 1_000_000, 1_000_000), ("m", 0, 0), ("?", 5, 5)], "model string, input_tokens bigint, output_tokens bigint")
    assert sorted(r.cost_usd for r in cost.with_cost(use, prices).collect()) == [0, 0, 3, 18]
    with pytest.warns(UserWarning):
        assert cost.price_overrides("{broken") == []


def test_report_summary(spark):
    known = spark.createDataFrame([("a", "text-change", None), ("b", "none", None)], PAIRS)
    prices = cost.pricing(spark, [("m", 1e6, 0.0)])

    def of(*rows):
        return cost.report_summary(known, spark.createDataFrame(list(rows), RESULT), prices).first()

    r = of(result("a", cached=True), result("b", cached=False, tokens=(4, 0)), result("?", cached=False, tokens=(2, 0)), result("?", tokens=(6, 0)))
    assert (r.changed_count, r.none_count, r.cache_hits, r.cache_misses, r.cost_usd, r.saved_usd) == (3, 1, 1, 2, 12, 6)
    assert of(result("a", cached=True)).saved_usd == 0


def test_cache_keys(spark):
    df = spark.createDataFrame([(b"a", b"b")], "p binary, q binary")
    one = df.select(cache.content_key(F.col("p"), F.col("q")).alias("k"), cache.content_key(F.col("q"), F.col("p")).alias("r"), cache.content_key(F.col("p"), F.col("q"), F.lit("c")).alias("c"), cache.content_key(F.col("p"), F.col("q"), F.lit("")).alias("e")).first()
    assert one.k == one.e and len({one.k, one.r, one.c}) == 3


def test_read_through(spark):
    now = F.expr("timestamp '2024-01-10 00:00:00'")
    entries = spark.createDataFrame([("old", "x", "2024-01-01 00:00:00"), ("new", "y", "2024-01-09 00:00:00"), ("new", "z", "2024-01-08 00:00:00"), ("undated", "u", None)], "key string, classification string, at string")
    entries = entries.select("key", "classification", F.col("at").cast("timestamp").alias("cached_at"))
    asked = spark.createDataFrame([(k,) for k in ("old", "new", "undated", "none", "none")], "key string")

    def call(keys):
        return keys.select("key", F.lit("fresh").alias("classification"), F.lit(10).cast("bigint").alias("input_tokens"), F.lit(5).cast("bigint").alias("output_tokens"))

    out, new = cache.read_through(asked, entries, now, call)
    assert sorted((r.key, r.classification, r.cached, r.input_tokens) for r in out.collect()) == [("new", "y", True, 0), ("none", "fresh", False, 10), ("none", "fresh", False, 10), ("old", "fresh", False, 10), ("undated", "u", True, 0)]
    assert sorted(r.key for r in new.collect()) == ["none", "old"]


def test_hits_do_not_renew(spark):
    log = spark.createDataFrame([(i, "k", f"2024-01-{d:02} 00:00:00") for i, d in enumerate((1, 5, 8, 9, 20))], "id bigint, key string, at string").withColumn("at", F.col("at").cast("timestamp"))
    assert [r.hit for r in cache.replay(log).orderBy("id").collect()] == [False, True, True, False, False]


def test_geometry(spark):
    df = spark.createDataFrame([((0.0, 0.0, 10.0, 10.0), (10.0, 0.0, 5.0, 5.0))], "a struct<x:double,y:double,w:double,h:double>, b struct<x:double,y:double,w:double,h:double>")
    r = df.select(geo.overlap(Rect("a."), Rect("b.")).alias("touch"), geo.overlap(Rect("a."), Rect("b."), 8).alias("near"), geo.iou(Rect("a."), Rect("b.")).alias("iou"), geo.round_half_up(F.lit(-2.5)).alias("r")).first()
    assert (r.touch, r.near, r.iou, r.r) == (False, True, 0.0, -2)
    empty = df.limit(0).select("a.*").agg(*geo.bounding_box()).first()
    assert empty.x is None


def test_html_walk():
    page = "<html><body><div id=a class='b c'><p>one<p>two<br></div><input value=v><ul><li>x<li>y</ul><script>s()</script></body></html>"
    got = [(p, i, t) for _, p, _, i, _, t in html_dom.html_nodes(page)]
    assert got == [("DIV:0", "a", ""), ("DIV:0>P:0", "", "one"), ("DIV:0>P:1", "", ""), ("DIV:0>P:1>BR:0", "", ""), ("INPUT:1", "", "v"), ("UL:2", "", ""), ("UL:2>LI:0", "", "x"), ("UL:2>LI:1", "", "y"), ("SCRIPT:3", "", "s()")]
    assert html_dom.html_nodes(None) == []


def _walked(page):
    walk = html_dom._Walk()
    walk.feed(page if "<body" in page.lower() else f"<body>{page}")
    walk.close()
    return [(i, n["path"], n["tag"], n["id"], n["class"], html_dom._text(n)) for i, n in enumerate(walk.nodes)]


def test_plain_pages_are_read_as_the_parser_reads_them():
    """Random pages of plain and odd pieces: the same nodes as the parser's; plain ones don't need the parser, and odd ones are left to it."""
    import random

    plain = ["<p>", "</p>", "<div id=\"a\" class='b'>".replace("'", '"'), "</div>", "<ul>", "</ul>", "<li>", "</li>", "<br>", "<br/>", "<input type=text value=\"x &amp; y\"/>", "<input disabled value=7 >", "<B ID=Q>", "</b >", "t &lt; u", " \n ", "&amp", "&#39;x", "<textarea>in &gt;</textarea>", "<textarea value=\"v\"></textarea>", "<body>", "</body>", "<head><title>t</title></head>", "<!doctype html>", "<section id=\"a\" id=\"b\">", "</section>", "<h1>", "</h1>"]
    odd = ["<!-- c <p> -->", "<script>if (a < b) {}</script>", "<style>p > b</style>", "<textarea>a<b>c</textarea>", "<a href='x'>", "<a href=x/>", "<a/b>", "<", "</>", "< p>", "<![CDATA[x]]>", "<?x?>", "<p", "</p x>", "<textarea/>", "<title>", "<a b=\"c>d\">", "<a b=>", "<x-y>", "<svg><path/></svg>", "<a  =b>", "&"]
    rng = random.Random(3)
    for i in range(4000):
        page = "".join(rng.choices(plain + (odd if i % 2 else []), k=rng.randint(0, 14)))
        assert html_dom.html_nodes(page) == _walked(page), page
        assert i % 2 or html_dom._plain_nodes(page) is not None, page


def test_mutations(spark):
    def one(i):
        m = mutate.MUTATIONS[i]
        rows = [(*node(), m[3], m[4])]
        return mutate.mutate(spark.createDataFrame(rows, NODE + ", effect string, argument string")).collect()

    assert [r.x for r in one(1)] == [38.0] and [r.w for r in one(4)] == [110.0] and one(9) == [] and len(one(8)) == 2
    assert one(3)[0].background_color == "#dc2626" and one(12)[0].x == 10.0 and one(6)[0].text == "hello (new)"
    image = mutate.draw_box(white(10), 2, 2, 20, 5, (0, 0, 0))
    assert (image[2, 2:] == (0, 0, 0, 255)).all() and (image[4, 5] == 255).all()


def test_pairs_and_subsets(spark, tmp_path):
    row = {"id": "a-none", "fixture": "a", "kind": "none", "domBefore": "[]", "domAfter": "[]"}
    (tmp_path / "p.json").write_text(json.dumps([row, row | {"id": "b-none"}]))
    known = pairs.read_pairs(spark, str(tmp_path / "p.json"))
    assert [r.id for r in pairs.subset(known, ["b-none", "a-none"]).orderBy("place").collect()] == ["b-none", "a-none"]
    assert pairs.subset_if_present(known, ["a-none", "zzz"]).count() == 1
    with pytest.raises(Exception, match="no such pair"):
        pairs.subset(known, ["zzz"]).collect()


def test_html_report(spark, tmp_path):
    known = spark.createDataFrame([("<a>", "none", None)], PAIRS)
    shots = spark.createDataFrame([("<a>", b"\x00" * 90, b"")], "pair_id string, before binary, after binary")
    rows = report.html_rows(spark.createDataFrame([result("<a>"), result("unknown")], RESULT), known, shots)
    assert rows.count() == 1 and "&lt;a&gt;" in rows.first().row and "\r" not in rows.first().row
    report.write_html(rows, "t", str(tmp_path / "out"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sum("<table>" in x for x in lines) == 1 and any("&lt;a&gt;" in x for x in lines)
    summary = spark.createDataFrame([(1,)], "n int")
    assert json.loads(report.metrics_json(spark.createDataFrame([("arm", 1.0)], "baseline string, recall double"), summary).first().report) == {"arms": [{"baseline": "arm", "recall": 1.0}], "summary": {"n": 1}}


def test_prompts_and_formats(spark):
    df = spark.createDataFrame([(["rect", "text"], "x"), (["rect"], ""), (None, None)], "f array<string>, i string")
    out = [r.p for r in df.select(text.prompt(F.col("f"), F.col("i")).alias("p")).collect()]
    assert out[0].endswith("changes in: rect, text of #x.") and out[1].endswith("in: rect.") and "DOM" not in out[2]


def test_providers():
    presets = [config.Preset("one", "ONE_KEY", "m1"), config.Preset("two", "TWO_KEY", "m2")]
    env = {"ONE_KEY": "k", "TWO_KEY": "k", "TWO_MODEL": "other"}
    first = config.pick(presets, env)
    assert (first.preset.name, first.model) == ("one", "m1")
    assert config.pick_judge(presets, env, first).model == "other"
    assert config.pick_judge(presets, env, first, "one").preset.name == "one"
    with pytest.warns(UserWarning):
        assert config.pick_judge(presets, {"ONE_KEY": "k"}, first) == first
    for bad in ({"name": "zzz"}, {}):
        with pytest.raises(ValueError):
            config.pick(presets, {}, **bad)


def test_streamed_pairs(spark, tmp_path):
    from framewright.streaming import detect

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "p.json").write_text("\n".join(json.dumps({"id": i, "domBefore": "[]", "domAfter": a}) for i, a in (("same", "[]"), ("other", "[1]"))))
    q = detect.candidates(detect.stream_pairs(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("seen").start()
    q.processAllAvailable()
    q.stop()
    assert [r.id for r in spark.table("seen").collect()] == ["other"]


def _smoothed_one(rgba, other, y, x):
    """Pixel by pixel, what the vectorised rule says of a smoothed edge."""
    h, w = rgba.shape[:2]
    luma = raster._luma(rgba)

    def plain(image, v, u):
        same = int(u in (0, w - 1) or v in (0, h - 1))
        for p in range(max(v - 1, 0), min(v + 2, h)):
            for q in range(max(u - 1, 0), min(u + 2, w)):
                same += (p, q) != (v, u) and (image[p, q] == image[v, u]).all()
        return same > 2

    equal, low, high = int(x in (0, w - 1) or y in (0, h - 1)), (0.0, None), (0.0, None)
    for v in range(max(y - 1, 0), min(y + 2, h)):
        for u in range(max(x - 1, 0), min(x + 2, w)):
            d = luma[y, x] - luma[v, u]
            if (v, u) == (y, x):
                continue
            equal += d == 0
            low, high = (d, (v, u)) if d < low[0] else low, (d, (v, u)) if d > high[0] else high
    if equal > 2 or low[1] is None or high[1] is None:
        return False
    return any(plain(rgba, *at) and plain(other, *at) for at in (low[1], high[1]))


def test_smoothed_edges_are_those_of_the_rule():
    rng = np.random.default_rng(11)
    seen = 0
    for _ in range(30):
        levels = rng.integers(0, 3, (9, 11))
        levels[:, :4], levels[6:, :] = 0, 2
        a = np.full((9, 11, 4), 255, np.uint8)
        a[..., :3] = (levels * 100)[..., None]
        b = a.copy()
        b[rng.random((9, 11)) < 0.2, :3] = 150
        y, x = np.nonzero(np.ones((9, 11)))
        got = raster._smoothed(a, b, y, x)
        assert got.tolist() == [_smoothed_one(a, b, int(v), int(u)) for v, u in zip(y, x)]
        seen += int(got.sum())
    assert seen > 20


def test_a_smoothed_edge_is_no_change():
    before = np.full((20, 20, 4), 255, np.uint8)
    before[:, :10, :3] = 0
    after = before.copy()
    after[:, 10, :3] = 120  # a grey rim between black and white
    assert not raster.change_mask(before, after).any()
    after[5:9, 12:16, :3] = 90
    assert raster.change_mask(before, after).sum() == 16


def _merged_one_by_one(boxes, gap):
    rows = [list(r) for r in boxes]
    again = True
    while again:
        again = False
        for i in range(len(rows)):
            for j in range(i + 1, len(rows)):
                (ax, ay, aw, ah, an), (bx, by, bw, bh, bn) = rows[i], rows[j]
                if ax < bx + bw + gap and bx < ax + aw + gap and ay < by + bh + gap and by < ay + ah + gap:
                    x, y = min(ax, bx), min(ay, by)
                    rows[i] = [x, y, max(ax + aw, bx + bw) - x, max(ay + ah, by + bh) - y, an + bn]
                    del rows[j]
                    again = True
                    break
            if again:
                break
    return rows


def test_boxes_merge_as_one_by_one(monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(raster, "_SWEEP", 7)
    for n in (0, 1, 2, 9, 40):
        for spread in (60, 200, 600):
            boxes = np.stack((rng.integers(0, spread, n), rng.integers(0, spread, n), rng.integers(1, 20, n), rng.integers(1, 20, n), rng.integers(1, 9, n)), axis=1).reshape(-1, 5)
            assert raster.merge_boxes(boxes, 8).tolist() == _merged_one_by_one(boxes.tolist(), 8)


def test_missing_files_and_pairs_are_errors(spark, tmp_path):
    images = spark.createDataFrame([("a.png", b"1"), ("b.png", b"2")], "name string, content binary")
    ok = spark.createDataFrame([("p", "x/a.png", "b.png")], "id string, before string, after string")
    assert [(bytes(r.before_png), bytes(r.after_png)) for r in png.with_images(ok, images).collect()] == [(b"1", b"2")]
    with pytest.raises(Exception, match="no such file: c.png"):
        png.with_images(ok.withColumn("after", F.lit("d/c.png")), images).collect()
    results = spark.createDataFrame([("p", 1), ("q", 2)], "pair_id string, n int")
    assert metrics.matched(results.where("n = 1"), ok).count() == 1
    with pytest.raises(Exception, match="no such pair: q"):
        metrics.matched(results, ok).collect()
    png.write_images(images, str(tmp_path / "out"))
    assert sorted((r.name, bytes(r.content)) for r in png.read_images(spark, str(tmp_path / "out")).collect()) == [("a.png", b"1"), ("b.png", b"2")]


def test_a_named_provider_needs_its_key():
    presets = [config.Preset("one", "ONE_KEY", "m1"), config.Preset("two", "TWO_KEY", "m2")]
    assert config.pick(presets, {"TWO_KEY": "k"}, "two").model == "m2"
    with pytest.raises(ValueError, match="ONE_KEY"):
        config.pick(presets, {"TWO_KEY": "k"}, "one")


def test_appended_entries_are_read_back(spark, tmp_path):
    path = str(tmp_path / "cache")
    schema = "key string, classification string, cached_at timestamp"
    row = lambda k, c, t: spark.sql(f"select '{k}' as key, '{c}' as classification, timestamp '{t}' as cached_at")
    kind = row("k", "c", "2024-01-01").schema
    assert cache.entries_at(spark, path, kind).count() == 0
    for k, c, t in (("k", "old", "2024-01-01"), ("k", "new", "2024-01-03"), ("other", "x", "2024-01-02")):
        cache.append(row(k, c, t), path)
    assert sorted((r.key, r.classification) for r in cache.latest(cache.entries_at(spark, path, kind)).collect()) == [("k", "new"), ("other", "x")]
    store = cache.MemoryStore(spark.createDataFrame([], schema))
    store.append(row("k", "c", "1990-01-01"))
    asked = spark.createDataFrame([("k",), ("z",)], "key string")
    assert sorted((r.key, r.hit) for r in cache.probe(asked, store.answers(), F.current_timestamp()).collect()) == [("k", True), ("z", False)]


def test_pairs_are_rendered_without_a_browser(spark):
    rows = [(k, o, f"n{o}", f"n{o}", "t", 10.0 * o, 8.0, 6.0, 5.0, "c", "#0000ff", "400", "0px", e if o == 1 else None, a) for k, (e, a) in enumerate([("shift", "6"), ("remove", ""), ("add", ""), ("none", ""), ("background", "#dc2626")]) for o in (0, 1)]
    nodes = spark.createDataFrame(rows, "pair_id long, ord long, path string, id string, text string, x double, y double, w double, h double, color string, background_color string, font_weight string, border_radius string, effect string, argument string")
    got = {r.pair_id: r for r in mutate.render_pairs(nodes, 40, 20).collect()}
    blue = {k: [int((png.decode_png(bytes(x))[..., :3] == (0, 0, 255)).all(axis=2).sum()) for x in (r.before, r.after)] for k, r in got.items()}
    assert blue == {0: [60, 60], 1: [60, 30], 2: [60, 60], 3: [60, 60], 4: [60, 30]}
    assert {k: r.truth and tuple(r.truth) for k, r in got.items()} == {0: (16.0, 8.0, 6.0, 5.0), 1: (10.0, 8.0, 6.0, 5.0), 2: (10.0, 8.0, 6.0, 5.0), 3: None, 4: (10.0, 8.0, 6.0, 5.0)}
    assert [r.changed_pixels for r in raster.pixel_regions(mutate.render_pairs(nodes.where("pair_id = 4"), 40, 20)).collect()] == [30]


def test_dom_diff_of_a_hot_pair_and_of_repeats(spark):
    rows = [(1, i, f"p{i % 500}", None, "t", float(i), 0.0, 1.0, 1.0, "c", "b", "400", "0px") for i in range(1000)]
    schema = "pair_id long, ord long, path string, id string, text string, x double, y double, w double, h double, color string, background_color string, font_weight string, border_radius string"
    before = spark.createDataFrame(rows, schema)
    assert domdiff.dom_diff(before, before).count() == 0
    changed = domdiff.dom_diff(before, before.where("ord < 500")).collect()
    assert len(changed) == 500 and {tuple(r.changed_fields) for r in changed} == {("rect",)} and {r.ord for r in changed} == set(range(500))
    regions = fusion.candidate_regions(domdiff.dom_diff(before, before.where("ord < 500")), spark.createDataFrame([(1, 0, 3.5, 0.5, 1.0, 1.0), (1, 1, 900.0, 900.0, 1.0, 1.0), (2, 0, 0.0, 0.0, 9.0, 9.0)], "pair_id long, ord long, x double, y double, w double, h double"))
    found = {r.source: 0 for r in regions.collect()}
    for r in regions.collect():
        found[r.source] += 1
    assert found == {"dom": 498, "dom+pixel": 2, "pixel": 1}
