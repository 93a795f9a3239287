"""Queries on whole runs: nested reports, judged descriptions, the arm from screenshots on, pages and smoothed edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import classify, cost, fusion, raster, report
from ..operators.cache import TTL_MS
from ..operators.cache_table import CacheTable
from ..sources import html_dom, png
from ..sources.shared import new_path
from ..streaming import replay
from .inputs import cte, of
from .registry import NOW, ORACLES, PRICES, PRICES_SQL, REGIONS, REPLIES_SQL, SCORES, SHOTS, CropModel, query, regions_of, shots, summary

_TYPE = "case when change_type is null then 'null' else concat('\"', change_type, '\"') end"
_SOURCES = ["dom", "pixel", "dom+pixel"]


def _class_sql(i: int, dx: float, dy: float) -> str:
    rect = f"""'{{"region":{{"x":', x + {dx}e0, ',"y":', y + {dy}e0, ',"w":', w, ',"h":', h"""
    return f"""concat({rect}, '}},"source":"{_SOURCES[i]}","change_type":', {_TYPE}, ',"description":"region {i}","confidence":0.{5 + i}}}')"""


_CLASSES = "case pair_id % 4 " + " ".join(f"when {k} then " + (f"concat_ws(',', {', '.join(_class_sql(i, *at) for i, at in enumerate(v))})" if v else "''") for k, v in REGIONS.items()) + " end"
_SAID = """coalesce('"said \\"' || case when pair_id % 5 <> 0 then change_type end || '\\" of ' || pair_id || '"', 'null')"""
_DETAIL = f"""concat('{{"id":', pair_id, ',"kind":"', kind, '","changed":', case when changed then 'true' else 'false' end, ',"change_type":', {_TYPE}, ',"description":', {_SAID},
    ',"regions_classified":', pair_id % 4, ',"classifications":[', {_CLASSES}, '],"input_tokens":', input_tokens, ',"output_tokens":', output_tokens, '}}')"""


def _details(spark, sf_dir) -> DataFrame:
    r = regions_of(of(spark, sf_dir, "results").where("known"))
    said = F.when(F.col("pair_id") % 5 != 0, F.concat(F.lit('said "'), "change_type", F.lit('" of '), F.col("pair_id").cast("string")))

    def classified(region, i):
        source = F.element_at(F.array(*(F.lit(x) for x in _SOURCES)), i + 1)
        confidence = F.element_at(F.array(*(F.lit(x) for x in (0.5, 0.6, 0.7))), i + 1)
        return F.struct(region.alias("region"), source.alias("source"), F.col("change_type"), F.concat(F.lit("region "), i.cast("string")).alias("description"), confidence.alias("confidence"))

    r = r.withColumn("description", said).withColumn("classifications", F.transform("regions", classified))
    return report.pair_details(r.select(F.col("pair_id").alias("id"), "kind"), r.drop("kind"))


@query(cte("results") + f" select baseline, pair_id, {_DETAIL} as detail from results where known")
def pair_details(spark, sf_dir):
    """What each arm says of each known pair, with its classified regions."""
    return _details(spark, sf_dir)


@query(
    SCORES + f""", {PRICES_SQL}, d as (select baseline, pair_id, {_DETAIL} as detail from results where known),
t as (select count(distinct pair_id) as pairs, count(*) as n, cast(sum(input_tokens) as bigint) as ti, cast(sum(output_tokens) as bigint) as tout,
    floor(sum(coalesce(input_tokens / 1e6 * pi + output_tokens / 1e6 * po, 0)) * 10000 + 0.5e0) / 10000 as cost from results left join prices using (model))
select 0 as place, null as baseline, null as pair_id, '{{"arms":[' as line union all
select 1, baseline, null, concat(case when baseline = (select min(baseline) from s) then '' else ']}},' end, '{{"baseline":"', baseline, '","metrics":{{"n":', n, ',"recall":', round(tp / real, 6), ',"region_precision":', round(hit / tp, 6),
    ',"false_positive_rate":', round(fp / none, 6), ',"type_accuracy":', round(correct / typed, 6), '}},"perPair":[') from s union all
select 1, baseline, pair_id, concat(case when pair_id = min(pair_id) over (partition by baseline) then '' else ',' end, detail) from d union all
select 2, null, null, concat(']}}],"totals":{{"total_pairs":', pairs, ',"total_results":', n, ',"total_input":', ti, ',"total_output":', tout, ',"cost_usd":', cost, '}}}}') from t"""
)
def run_document(spark, sf_dir):
    """One nested JSON document of arms, their pairs and these pairs' regions, a pair a line."""
    scores = summary(spark, sf_dir).select("baseline", "n", *(F.round(c, 6).alias(c) for c in ("recall", "region_precision", "false_positive_rate", "type_accuracy")))
    return report.run_document(scores, _details(spark, sf_dir), report.run_totals(of(spark, sf_dir, "results"), cost.pricing(spark, PRICES)))


@query(
    REPLIES_SQL + """, d as (select *, case when event_id % 6 = 0 then null when event_id % 6 = 1 then '' else concat('saw ', event_type) end as description from replies)
select event_id, description, cast(case when coalesce(description, '') = '' then 1 else case form when 5 then least(5, greatest(1, user_id % 9)) when 7 then least(5, greatest(1, user_id % 7 + 1)) else 1 end end as int) as score,
    case when coalesce(description, '') = '' then 'no description' else case form when 5 then 'r' when 3 then trim(reply) when 4 then 'null' when 6 then reply else '' end end as rationale from d"""
)
def judged_descriptions(spark, sf_dir):
    """Descriptions judged by a model whose answers are the replies; missing and empty ones are never sent."""
    said = of(spark, sf_dir, "replies")
    form = F.col("event_id") % 6
    rows = said.select("event_id", F.when(form == 1, "").when(form > 1, F.concat(F.lit("saw "), "event_type")).alias("description"))

    def call(asked: DataFrame) -> DataFrame:
        sent = asked.withColumn("key", F.when(F.col("description") == "", F.raise_error(F.lit("an empty description was sent")).cast("bigint")).otherwise(F.col("event_id")))
        return classify.scripted(sent, said.select(F.col("event_id").alias("key"), F.col("reply").alias("text")))

    return classify.judged(rows, call)


@query(
    SHOTS + """, r as (select pair_id, x, y, w, h, 0 as ord, true as hinted from s where not quiet and not pixels_only union all select pair_id, 89, 55, 4, 4, 1, true from s where twice
    union all select pair_id, x, y, w, h, 2, false from s where not quiet and pixels_only and twice),
c as (select *, greatest(x - 16, 0) as cx, greatest(y - 16, 0) as cy, row_number() over (partition by pair_id order by w * h desc, ord) as rank from r),
k as (select pair_id, count(*) as n, max(case when rank = 1 then case when hinted then 'color-change' else 'other' end end) as change_type,
    max(case when rank = 1 then concat(least(96 - cx, w + 32), 'x', least(64 - cy, h + 32)) end) as description from c group by pair_id)
select s.pair_id, n is not null as changed, coalesce(n, 0) as n_regions, change_type, description, coalesce(10 * n, 0)::bigint as input_tokens, coalesce(5 * n, 0)::bigint as output_tokens,
    case when n is not null then false end as cached from s left join k using (pair_id)"""
)
def pipeline_arm(spark, sf_dir):
    """The whole arm on snapshots and screenshots: regions, the largest 8 of a pair classified through an empty cache, and what they say of each pair."""
    before, after, images = shots(spark, sf_dir)
    regions = fusion.detect(before, after, images)[0]
    none = spark.createDataFrame([], "key string, classification struct<change_type:string,description:string,confidence:double>, cached_at timestamp")
    out = classify.pipeline_arm(images, regions, lambda top: classify.classify_regions(top.drop("rank"), images, none, CropModel, F.expr(NOW))[0])
    return out.withColumn("regions", F.size("regions").cast("bigint")).withColumnRenamed("regions", "n_regions")


def _html(text: str) -> str:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#39;")):
        text = f"replace({text}, '{raw}', '{safe}')"
    return text


@query(
    cte("results") + f""" select r.pair_id, concat('<tr><td>', r.pair_id, '</td><td>', kind, '</td><td>', coalesce(change_type, '-'), '</td><td>', {_html("coalesce(change_type || ' <of> ' || url, '')")}, '</td><td>',
    '<img src="data:image/png;base64,', base64(encode(url)), '">', '</td><td>', '<img src="data:image/png;base64,', base64(encode(html)), '">', '</td></tr>') as row
    from results r join pages p on p.page_id = r.pair_id where known"""
)
def html_report(spark, sf_dir):
    """Table rows of a report; pages' bytes stand for screenshots."""
    r, pages = of(spark, sf_dir, "results").where("known"), spark.read.parquet(f"{sf_dir}/pages.parquet")
    images = pages.select(F.col("page_id").alias("pair_id"), "url", F.encode("url", "UTF-8").alias("before"), F.encode("html", "UTF-8").alias("after"))
    known = r.join(images.select("pair_id", "url"), "pair_id")
    results = known.withColumn("description", F.concat("change_type", F.lit(" <of> "), "url"))
    return report.html_rows(results.drop("kind"), known.select(F.col("pair_id").alias("id"), "kind"), images)


@query(
    cte("dom_before") + """, n as (select *, concat('SECTION:', ord) as top, concat('c', ord % 3, ' wide') as class_name, ord * 9 as o from dom_before),
parts(part, step, tag) as (values (0, '', 'SECTION'), (1, '>P:0', 'P'), (2, '>P:0>BR:0', 'BR'), (3, '>UL:1', 'UL'), (4, '>UL:1>LI:0', 'LI'), (5, '>UL:1>LI:1', 'LI'), (6, '>INPUT:2', 'INPUT'), (7, '>TEXTAREA:3', 'TEXTAREA'), (8, '>B:4', 'B'))
select pair_id as page_id, cast(o + part as int) as ord, concat(top, step) as path, tag, case part when 0 then id else '' end as id, case part when 0 then n.class_name else '' end as class_name,
    case part when 4 then concat('a & ', path) when 5 then concat(text, ' <', color, '>') when 6 then font_weight when 7 then concat('in ', path) when 8 then concat(text, ' b') else '' end as text from n, parts"""
)
def written_page_nodes(spark, sf_dir):
    """Pages of an order each, a section a line, written from known nodes and parsed back: void and unclosed elements, references, fields, nested text."""
    section = F.concat(
        F.lit('<section id="'), "id", F.lit('" class="c'), (F.col("ord") % 3).cast("string"), F.lit(' wide"><p>\n line<br> '), "path", F.lit("<ul><li> a &amp; "), "path", F.lit("\t<li>"), "text", F.lit(" &lt;"), "color",
        F.lit('&gt;</ul><input type=text value="'), "font_weight", F.lit('"/><textarea>in '), "path", F.lit("</textarea><b> "), "text", F.lit(" b </b></section>"),
    )
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ord", section.alias("s")))), lambda r: r["s"])
    html = F.concat(F.lit("<!doctype html><html><head><title>t</title></head><body>"), F.array_join(lines, "\n"), F.lit("</body></html>"))
    return html_dom.page_nodes(of(spark, sf_dir, "dom_before").groupBy(F.col("pair_id").alias("page_id")).agg(html.alias("html")))


#: Size of the images that stand for suppliers: a slanting edge with a grey rim, which moves a little, and a box that changes its colour.
WIDE, TALL = 24, 16
#: Pairs of images that a task makes and compares.
PAIRS = 512
_LUMA = " + ".join(f"{w}e0 * {c}" for w, c in zip(raster.YIQ["y"], "rgb", strict=True))
_PARTS = {k: " + ".join(f"({w}e0) * (b.{c} - a.{c})" for w, c in zip(ws, "rgb", strict=True)) for k, ws in raster.YIQ.items()}
_DELTA = " + ".join(f"{raster.YIQ_WEIGHTS[k]}e0 * ({v}) * ({v})" for k, v in _PARTS.items())


def _shade(first: int, boxed: int) -> str:
    return f"case when boxed then {boxed}e0 when slope < 0 then {first}e0 when slope < 2 then 120e0 else 220e0 end"


@query(
    f"""with px as (select s_suppkey as pair_id, img, i % {WIDE} as x, i // {WIDE} as y, 2 * (i % {WIDE}) + 3 * (i // {WIDE}) - 20 - s_suppkey % 17 - img * (s_suppkey % 3) as slope,
    img = 1 and s_suppkey % 2 = 0 and i % {WIDE} between 15 and 18 and i // {WIDE} between 4 and 7 as boxed from supplier, (values (0), (1)) as v(img), unnest(generate_series(0, {WIDE * TALL - 1})) as t(i)),
rgb as (select *, {_shade(30, 200)} as r, {_shade(30, 60)} as g, {_shade(40, 90)} as b, (x = 0 or y = 0 or x = {WIDE - 1} or y = {TALL - 1})::int as rim from px),
lit as (select *, {_LUMA} as luma from rgb),
near as (select c.pair_id, c.img, c.x, c.y, c.rim, n.x as nx, n.y as ny, c.luma - n.luma as d, (c.r = n.r and c.g = n.g and c.b = n.b)::int as same
    from lit c join lit n on n.pair_id = c.pair_id and n.img = c.img and abs(n.x - c.x) <= 1 and abs(n.y - c.y) <= 1 and (n.x <> c.x or n.y <> c.y)),
around as (select pair_id, img, x, y, rim + count(*) filter (where d = 0) as equal, min(d) as low, max(d) as high, rim + sum(same) > 2 as plain,
    first(nx order by d, ny, nx) as lx, first(ny order by d, ny, nx) as ly, first(nx order by -d, ny, nx) as hx, first(ny order by -d, ny, nx) as hy from near group by pair_id, img, x, y, rim),
plains as (select pair_id, x, y, bool_and(plain) as both from around group by all),
smoothed as (select a.pair_id, a.x, a.y from around a join plains l on l.pair_id = a.pair_id and l.x = a.lx and l.y = a.ly join plains h on h.pair_id = a.pair_id and h.x = a.hx and h.y = a.hy
    where a.equal <= 2 and a.low < 0 and a.high > 0 and (l.both or h.both)),
changed as (select b.pair_id, b.x, b.y from rgb b join rgb a on a.pair_id = b.pair_id and a.x = b.x and a.y = b.y where b.img = 0 and a.img = 1 and {_DELTA} > {raster.LARGEST_DELTA * raster.THRESHOLD**2}e0)
select pair_id, x, y from changed where (pair_id, x, y) not in (select pair_id, x, y from smoothed)"""
)
def smoothed_edges(spark, sf_dir):
    """Changed pixels of screenshots whose edges are smoothed: rims that move don't count."""

    def run(frames):
        y, x = np.mgrid[0:TALL, 0:WIDE]
        for frame in frames:
            images = {"before": [], "after": []}
            for key in frame["pair_id"].tolist():
                for img, name in enumerate(images):
                    slope = 2 * x + 3 * y - 20 - key % 17 - img * (key % 3)
                    rgba = np.full((TALL, WIDE, 4), 255, np.uint8)
                    rgba[..., :3] = np.where(slope < 0, 30, np.where(slope < 2, 120, 220))[..., None]
                    rgba[slope < 0, 2] = 40
                    if img and key % 2 == 0:
                        rgba[4:8, 15:19, :3] = (200, 60, 90)
                    images[name].append(png.encode_png(rgba))
            yield frame.assign(**images)

    keys = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("bigint").alias("pair_id"))
    keys = keys.repartition(keys.count() // PAIRS + 1)  # a file of few bytes is one task, and here a lot of images
    return raster.changed_pixels(keys.mapInPandas(run, "pair_id bigint, before binary, after binary"))


@query(
    cte("requests") + f""", entries as (select key, max(asked) as cached_at from requests where id % 4 <> 3 group by key)
select id, key, coalesce(epoch_ms({NOW}) - epoch_ms(cached_at) <= {TTL_MS}, false) as hit, case when epoch_ms({NOW}) - epoch_ms(cached_at) <= {TTL_MS} then cast(epoch_us(cached_at) as varchar) end as classification
from requests left join entries using (key) where id % 4 = 3"""
)
def cache_table_lookup(spark, sf_dir):
    """Answers appended in three batches, one of them twice, and merged before and after the last one, then looked up by the requests that are left."""
    log = of(spark, sf_dir, "requests")
    asked = F.col("asked").cast("timestamp")
    entries = log.select("id", "key", F.unix_micros(asked).cast("string").alias("classification"), asked.alias("cached_at"))
    table = CacheTable(spark, new_path(spark, "cache"), entries.drop("id").schema, digits=1)
    for k in (2, 0, 0, 1):  # the latest come first, which a merge must not undo
        table.append(entries.where(F.col("id") % 4 == k), f"batch-{k}")
        if k:
            table.compact()
    table.vacuum()
    return table.lookup(log.where("id % 4 = 3").select("id", "key"), F.expr(NOW)).select("id", "key", "hit", "classification")


@query(ORACLES["cache_replay"])
def streamed_cache_replay(spark, sf_dir):
    """The request log as a stream of four micro-batches, in order of time, through keyed state."""
    folder = new_path(spark, "stream")
    log = of(spark, sf_dir, "requests").withColumnRenamed("asked", "at")
    quarters = log.agg(F.percentile_approx(F.unix_millis(F.col("at").cast("timestamp")), [0.25, 0.5, 0.75]).alias("q")).first()["q"]
    millis = F.unix_millis(F.col("at").cast("timestamp"))
    for low, high in zip([None, *quarters], [*quarters, None], strict=True):
        part = log.where((millis > low) if low is not None else F.lit(True)).where((millis <= high) if high is not None else F.lit(True))
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")  # a file a batch: files are read in the order they came
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    replay.replayed(stream, folder)
    hits = spark.read.schema(replay.HITS).parquet(f"{folder}/hits")
    return hits.groupBy("key").agg(F.count("*").alias("requests"), F.count_if("hit").alias("hits"))
