"""All queries by name, and the SQL that each is compared with."""

from __future__ import annotations

import base64
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import replies, text
from ..functions.geometry import Rect
from ..operators import cache, classify, cost, domdiff, fusion, metrics, mutate, raster, report, spatial
from ..sources import html_dom, pairs, png
from ..sources.shared import written
from .inputs import KINDS, cte, of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Dollars per million tokens in and out.
PRICES = [("model-0", 3.0, 15.0), ("model-1", 15.0, 75.0), ("model-2", 0.8, 4.0), ("model-3", 5.0, 15.0), ("model-4", 0.15, 0.6)]
PRICES_SQL = "prices(model, pi, po) as (values " + ", ".join(f"('{m}', {i}e0, {o}e0)" for m, i, o in PRICES) + ")"
NOW = "timestamp '2024-02-01 00:00:00'"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domdiff.dom_diff(of(spark, sf_dir, "dom_before"), of(spark, sf_dir, "dom_after"))


_VALUES = "id, text, x, y, w, h, color, background_color, font_weight, border_radius"
_LAST = "select * from (select pair_id, path, min(ord) over (partition by pair_id, path) as ord, " + _VALUES + ", row_number() over (partition by pair_id, path order by ord desc) as rn from {0}) where rn = 1"
_DIFF = (
    ", b as (" + _LAST.format("dom_before") + "), a as (" + _LAST.format("dom_after") + "), joined as (select coalesce(b.pair_id, a.pair_id) as pair_id, coalesce(b.path, a.path) as path, "
    + ", ".join(f"case when a.path is null then b.{c} else a.{c} end as {c}" for c in ("id", "x", "y", "w", "h"))
    + """, case when b.path is null then 'added' when a.path is null then 'removed' else concat_ws(',',
        case when greatest(abs(b.x - a.x), abs(b.y - a.y), abs(b.w - a.w), abs(b.h - a.h)) > 1 then 'rect' end, """
    + ", ".join(f"case when b.{c} is distinct from a.{c} then '{n}' end" for c, n in domdiff.COMPARED)
    + ") end as changed_fields, coalesce(b.ord, a.ord + 1099511627776) as ord from b full outer join a on b.pair_id = a.pair_id and b.path = a.path), changes as (select * from joined where changed_fields <> '') "
)
_DOM = cte("dom_before", "dom_after") + _DIFF


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumn("changed_fields", F.array_join("changed_fields", ","))


@query(_DOM + "select pair_id, path, id, x, y, w, h, changed_fields, ord from changes")
def dom_diff(spark, sf_dir):
    return _flat(_changes(spark, sf_dir))


@query(_DOM + "select changed_fields, count(*) as n from changes where changed_fields in ('added', 'removed') group by all")
def dom_added_removed(spark, sf_dir):
    kinds = _flat(_changes(spark, sf_dir)).where(F.col("changed_fields").isin("added", "removed"))
    return kinds.groupBy("changed_fields").agg(F.count("*").alias("n"))


@query(_DOM + "select o_orderkey as pair_id, count(c.pair_id) as dom_change_count, count(c.pair_id) > 0 as changed from orders left join changes c on c.pair_id = o_orderkey group by o_orderkey")
def dom_change_counts(spark, sf_dir):
    return domdiff.change_counts(_changes(spark, sf_dir), of(spark, sf_dir, "pairs").withColumnRenamed("id", "pair_id"))


@query(cte("dom_before") + _LAST.format("dom_before").replace("select *", " select pair_id, path, ord, " + _VALUES, 1))
def dom_dedupe_last_wins(spark, sf_dir):
    return domdiff.last_wins(of(spark, sf_dir, "dom_before"))


@query("select concat(n_name, '-', id) as pair_id, id, kind, magnitude, n_name as fixture from (values " + ", ".join(str(m[:3]) for m in mutate.MUTATIONS) + ") m(id, kind, magnitude), nation")
def mutation_matrix(spark, sf_dir):
    """Every mutation of every fixture; nations stand for fixtures."""
    kinds = spark.createDataFrame([m[:3] for m in mutate.MUTATIONS], "id string, kind string, magnitude string")
    pairs_ = _table(spark, sf_dir, "nation").select(F.col("n_name").alias("fixture")).crossJoin(F.broadcast(kinds))  # 13 fixed rows
    return pairs_.select(F.concat_ws("-", "fixture", "id").alias("pair_id"), "id", "kind", "magnitude", "fixture")


@query(cte("dom_before", "dom_after") + f" select pair_id, ord, path, {_VALUES} from dom_after")
def mutate_nodes(spark, sf_dir):
    effects = spark.createDataFrame([(i, m[3], m[4]) for i, m in enumerate(mutate.MUTATIONS)], "k bigint, effect string, argument string")
    return mutate.mutate(of(spark, sf_dir, "dom_before").join(F.broadcast(effects), "k").drop("k"))


_OVERLAP = "{a}.x < {b}.x + {b}.w + {g} and {b}.x < {a}.x + {a}.w + {g} and {a}.y < {b}.y + {b}.h + {g} and {b}.y < {a}.y + {a}.h + {g}"


@query(cte("boxes") + " select a.pair_id, a.ord as a, b.ord as b, " + _OVERLAP.format(a="a", b="b", g=0) + " as touching from boxes a join boxes b on a.pair_id = b.pair_id and a.ord < b.ord where " + _OVERLAP.format(a="a", b="b", g=8))
def rect_overlap_pairs(spark, sf_dir):
    boxes = of(spark, sf_dir, "boxes")
    both = spatial.overlapping(boxes, boxes, geo.GAP).where("a.ord < b.ord")
    return both.select("a.pair_id", F.col("a.ord").alias("a"), F.col("b.ord").alias("b"), geo.overlap(Rect("a."), Rect("b.")).alias("touching"))


_IOU = "greatest(least(x + w, tx + tw) - greatest(x, tx), 0) * greatest(least(y + h, ty + th) - greatest(y, ty), 0)"
_RESULTS = cte("results") + f", scored as (select *, {_IOU} / (w * h + tw * th - {_IOU}) as iou from results)"


@query(_RESULTS + " select pair_id, round(iou, 9) as iou, iou >= 0.3e0 as hit from scored")
def iou_scores(spark, sf_dir):
    r = of(spark, sf_dir, "results").select("pair_id", F.struct("x", "y", "w", "h").alias("p"), F.struct(*(F.col(f"t{c}").alias(c) for c in "xywh")).alias("t"))
    value = geo.iou(Rect("p."), Rect("t."))
    return r.select("pair_id", F.round(value, 9).alias("iou"), (value >= geo.HIT).alias("hit"))


@query(cte("boxes") + " select pair_id, ord, x, y, w, h from boxes where w * h >= 960 * 500 * 0.001e0")
def area_filter(spark, sf_dir):
    return of(spark, sf_dir, "boxes").where(geo.large_enough(Rect(), F.lit(960), F.lit(500))).select("pair_id", "ord", "x", "y", "w", "h")


@query(cte("dom_before") + " select pair_id, cast(min(x) as bigint) as x, cast(min(y) as bigint) as y, cast(max(x + w) - min(x) as bigint) as w, cast(max(y + h) - min(y) as bigint) as h from dom_before group by pair_id")
def union_bbox(spark, sf_dir):
    return of(spark, sf_dir, "dom_before").groupBy("pair_id").agg(*geo.bounding_box())


@query(cte("boxes") + " select pair_id, ord, greatest(x - 16, 0) as x, greatest(y - 16, 0) as y, least(220 - greatest(x - 16, 0), w + 32) as w, least(400 - greatest(y - 16, 0), h + 32) as h from boxes")
def crop_windows(spark, sf_dir):
    window = geo.crop_window(Rect(), F.lit(220), F.lit(400))
    return of(spark, sf_dir, "boxes").select("pair_id", "ord", *(c.alias(n) for c, n in zip(window, "xywh", strict=True)))


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(floor(l_extendedprice / 7e0 - 3000e0 + 0.5e0) as bigint) as x from lineitem")
def round_rect(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", geo.round_half_up(F.col("l_extendedprice") / 7.0 - 3000.0).alias("x"))


_FUSED = (
    cte("dom_before", "dom_after", "boxes") + _DIFF + ", regions as (select pair_id, ord, x, y, greatest(w, 1) as w, greatest(h, 1) as h, case when exists (select 1 from boxes p where p.pair_id = d.pair_id and "
    + _OVERLAP.format(a="d", b="p", g=0) + ") then 'dom+pixel' else 'dom' end as source, changed_fields, id as dom_id from changes d union all select pair_id, ord + 1125899906842624, x, y, greatest(w, 1), greatest(h, 1), 'pixel', null, null from boxes p "
    + "where pair_id in (select pair_id from changes) and not exists (select 1 from changes d where d.pair_id = p.pair_id and " + _OVERLAP.format(a="d", b="p", g=0) + ")) "
)


def _regions(spark, sf_dir):
    return fusion.candidate_regions(_changes(spark, sf_dir), of(spark, sf_dir, "boxes").select("pair_id", "ord", *(F.col(c).cast("double").alias(c) for c in "xywh")))


@query(_FUSED + "select * from regions")
def fusion_sources(spark, sf_dir):
    return _flat(_regions(spark, sf_dir))


@query(_FUSED + "select o_orderkey as pair_id, (select count(*) from boxes b where b.pair_id = o_orderkey) as pixel_region_count from orders where o_orderkey not in (select pair_id from changes)")
def suppressed_pairs(spark, sf_dir):
    pairs_ = of(spark, sf_dir, "pairs").withColumnRenamed("id", "pair_id")
    quiet = domdiff.change_counts(_changes(spark, sf_dir), pairs_).where("not changed").select("pair_id")
    counts = of(spark, sf_dir, "boxes").groupBy("pair_id").agg(F.count("*").alias("n"))
    return quiet.join(counts, "pair_id", "left").select("pair_id", F.coalesce("n", F.lit(0)).alias("pixel_region_count"))


_TOP = _FUSED + ", ranked as (select *, row_number() over (partition by pair_id order by w * h desc, ord) as rank from regions) "


@query(_TOP + "select pair_id, ord, w * h as area, rank from ranked where rank <= 3")
def top_regions(spark, sf_dir):
    return fusion.top_regions(_regions(spark, sf_dir), 3).select("pair_id", "ord", (F.col("w") * F.col("h")).alias("area"), F.col("rank").cast("bigint").alias("rank"))


@query(_TOP + "select pair_id, source, coalesce(dom_id, '') as dom_id from ranked where rank = 1")
def primary_region(spark, sf_dir):
    return fusion.top_regions(_regions(spark, sf_dir), 1).select("pair_id", "source", F.coalesce("dom_id", F.lit("")).alias("dom_id"))


def _pixels(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    following = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("following"))
    cells = e.join(following, "vec_id").select(F.col("vec_id").alias("pair_id"), F.posexplode(F.arrays_zip("embedding", "following")).alias("i", "v"))
    on = cells.where(F.abs(F.col("v.embedding") - F.col("v.following")) > 0.25)
    return on.select("pair_id", (F.col("i") % 8).cast("bigint").alias("x"), F.floor(F.col("i") / 8).alias("y"))


_PIXELS = """with recursive pixels as (
    select a.vec_id as pair_id, (i - 1) % 8 as x, (i - 1) // 8 as y from embeddings a join embeddings b on b.vec_id = a.vec_id + 1, unnest(generate_series(1, 64)) as g(i)
    where abs(a.embedding[i] - b.embedding[i]) > 0.25)"""


@query(
    _PIXELS + """, reach as (
    select pair_id, x, y, y * 8 + x as label from pixels
    union select p.pair_id, p.x, p.y, r.label from reach r join pixels p on p.pair_id = r.pair_id and abs(p.x - r.x) + abs(p.y - r.y) = 1),
labels as (select pair_id, x, y, min(label) as label from reach group by all)
select pair_id, min(x) as x, min(y) as y, max(x) - min(x) + 1 as w, max(y) - min(y) + 1 as h, count(*) as changed_pixels from labels group by pair_id, label"""
)
def mask_components(spark, sf_dir):
    return raster.mask_components(_pixels(spark, sf_dir)).drop("ord")


@query(cte("boxes") + " select count(distinct pair_id) as pairs, cast(sum(changed_pixels) as bigint) as pixels, 0 as still_near from boxes")
def merged_regions_invariant(spark, sf_dir):
    merged = raster.merged_regions(of(spark, sf_dir, "boxes"))
    near = merged.alias("a").join(merged.alias("b"), (F.col("a.pair_id") == F.col("b.pair_id")) & (F.col("a.ord") < F.col("b.ord")) & geo.overlap(Rect("a."), Rect("b."), geo.GAP))
    return merged.agg(F.countDistinct("pair_id").alias("pairs"), F.sum("changed_pixels").alias("pixels")).crossJoin(near.agg(F.count("*").cast("int").alias("still_near")))


def _merged_sql(boxes: str) -> str:
    """Boxes grow to the box around all boxes that are near, a step a round, and equal ones are one: an order's boxes are 7 at most, so 12 rounds are plenty."""
    grown = ", ".join(f"{f}({v}) as {n}" for f, v, n in (("min", "b.x", "x"), ("min", "b.y", "y"), ("max", "b.r", "r"), ("max", "b.d", "d")))
    return (
        cte("boxes").replace("with ", "with recursive ", 1) + f""", g as ({boxes}
    union all select a.t + 1, a.pair_id, a.ord, a.changed_pixels, {grown} from g a join g b on a.pair_id = b.pair_id and a.x < b.r + 8 and b.x < a.r + 8 and a.y < b.d + 8 and b.y < a.d + 8
        where a.t < 12 group by a.t, a.pair_id, a.ord, a.changed_pixels)
select pair_id, min(ord) as ord, x, y, r - x as w, d - y as h, cast(sum(changed_pixels) as bigint) as changed_pixels from g where t = 12 group by pair_id, x, y, r, d"""
    )


@query(_merged_sql("select 0 as t, pair_id, ord, changed_pixels, x, y, x + w as r, y + h as d from boxes"))
def merged_regions(spark, sf_dir):
    return raster.merged_regions(of(spark, sf_dir, "boxes"))


@query(_merged_sql("select 0 as t, pair_id, ord, changed_pixels, x * 40 as x, y * 9 as y, (x + w * 2) * 40 as r, (y + h) * 9 as d from boxes"))
def merged_regions_of_large_pages(spark, sf_dir):
    """Boxes of pages of several thousand pixels, which reach over the cells that they are merged in."""
    return raster.merged_regions(of(spark, sf_dir, "boxes").withColumns({"x": F.col("x") * 40, "y": F.col("y") * 9, "w": F.col("w") * 80, "h": F.col("h") * 9}))


_WIDE = f"""wide as (select n_nationkey as pair_id, i % 1500 as x, i // 1500 as y from nation, unnest(generate_series(0, 29999)) as t(i)
    where i % 1500 % (7 + n_nationkey) = 0 and i // 1500 < 15 + n_nationkey % 5 or i // 1500 = 9 and i % 1500 // 100 % 3 <> n_nationkey % 3)"""


@query(
    f"""with {_WIDE}, columns as (select pair_id, x, count(*) as n, bool_or(y = 9) as crossed, min(y) as top, max(y) as bottom from wide group by all),
bars as (select *, x - row_number() over (partition by pair_id order by x) as run from wide where y = 9),
runs as (select pair_id, run, min(x) as x0, max(x) as x1 from bars group by all)
select r.pair_id::bigint as pair_id, x0 as x, min(top) as y, x1 - x0 + 1 as w, max(bottom) - min(top) + 1 as h, cast(sum(n) as bigint) as changed_pixels
from runs r join columns c on c.pair_id = r.pair_id and c.x between x0 and x1 group by all"""
)
def mask_components_of_wide_images(spark, sf_dir):
    """Masks of 1500 pixels' width, whose bars run through several tiles and tie columns of pixels together."""
    n = F.col("n_nationkey")
    cells = _table(spark, sf_dir, "nation").select(n, F.explode(F.sequence(F.lit(0), F.lit(29999))).alias("i"))
    x, y = F.col("i") % 1500, F.floor(F.col("i") / 1500)
    on = ((x % (7 + n) == 0) & (y < 15 + n % 5)) | ((y == 9) & (F.floor(x / 100) % 3 != n % 3))
    return raster.mask_components(cells.where(on).select(n.cast("bigint").alias("pair_id"), x.alias("x"), y.alias("y"))).drop("ord")


def _level(v: str) -> str:
    return f"least(greatest(floor(({v} + 1e0) * 127.5e0), 0), 255)"


_YIQ = " + ".join(
    f"{raster.YIQ_WEIGHTS[k]}e0 * ({' + '.join(f'({w}e0) * (b{c} - a{c})' for w, c in zip(ws, 'rgb', strict=True))}) * ({' + '.join(f'({w}e0) * (b{c} - a{c})' for w, c in zip(ws, 'rgb', strict=True))})"
    for k, ws in raster.YIQ.items()
)


@query(
    f"with v as (select e.vec_id as pair_id, i - 1 as i, cast(e.embedding[i] as double) as p, cast(f.embedding[i] as double) as q, cast(g.embedding[i] as double) as r, cast(h.embedding[i] as double) as s "
    f"from embeddings e join embeddings f on f.vec_id = e.vec_id + 1 join embeddings g on g.vec_id = e.vec_id + 2 join embeddings h on h.vec_id = e.vec_id + 3, unnest(generate_series(1, 64)) as t(i)), "
    f"c as (select pair_id, i, {_level('p')} as br, {_level('q')} as bg, {_level('r')} as bb, {_level('q')} as ar, {_level('r')} as ag, {_level('s')} as ab from v) "
    f"select pair_id, i % 8 as x, i // 8 as y, round({_YIQ}, 4) as delta from c where {_YIQ} > {raster.LARGEST_DELTA * raster.THRESHOLD**2}e0"
)
def yiq_changed_pixels(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    rows = e.select("vec_id", F.col("embedding").alias("e0"))
    for k in (1, 2, 3):
        rows = rows.join(e.select((F.col("vec_id") - k).alias("vec_id"), F.col("embedding").alias(f"e{k}")), "vec_id")
    cells = rows.select(F.col("vec_id").alias("pair_id"), F.posexplode(F.arrays_zip("e0", "e1", "e2", "e3")).alias("i", "v"))
    level = {k: F.least(F.greatest(F.floor((F.col(f"v.e{k}").cast("double") + 1.0) * 127.5), F.lit(0)), F.lit(255)) for k in range(4)}
    names = {"b_r": 0, "b_g": 1, "b_b": 2, "a_r": 1, "a_g": 2, "a_b": 3}
    pixels = cells.select("pair_id", "i", *(level[k].alias(n) for n, k in names.items())).where(raster.pixel_changed())
    return pixels.select("pair_id", (F.col("i") % 8).cast("bigint").alias("x"), F.floor(F.col("i") / 8).alias("y"), F.round(raster.colour_delta(), 4).alias("delta"))


@query(cte("boxes") + " select o_orderkey as pair_id, count(b.pair_id) > 0 as changed, count(b.pair_id) as n_regions, 0::bigint as tokens from orders left join boxes b on b.pair_id = o_orderkey and b.w * b.h >= 480e0 group by o_orderkey")
def pixel_only_arm(spark, sf_dir):
    boxes = of(spark, sf_dir, "boxes").where(geo.large_enough(Rect(), F.lit(960), F.lit(500)))
    return classify.pixel_arm(of(spark, sf_dir, "pairs").withColumnRenamed("id", "pair_id"), boxes)


REPLIES_SQL = cte("replies")


@query(
    REPLIES_SQL + """ select event_id, case form when 0 then event_type when 1 then event_type else 'other' end as change_type,
    case form when 0 then concat('d', user_id) when 2 then 'no type' when 3 then trim(reply) when 4 then 'null' when 6 then reply else '' end as description,
    case form when 0 then 0.5e0 when 1 then 1e0 else 0e0 end as confidence from replies where form <> 5
    union all select event_id, event_type, '', 0e0 from replies where form = 5"""
)
def classification_parse(spark, sf_dir):
    rows = of(spark, sf_dir, "replies").withColumn("p", replies.parsed(F.col("reply")))
    return rows.select("event_id", *replies.classification(F.col("reply"), F.col("p")))


@query(
    REPLIES_SQL + """ select event_id, cast(case form when 5 then least(5, greatest(1, user_id % 9)) when 7 then least(5, greatest(1, user_id % 7 + 1)) else 1 end as int) as score,
    case form when 5 then 'r' when 3 then trim(reply) when 4 then 'null' when 6 then reply else '' end as rationale from replies"""
)
def judge_parse(spark, sf_dir):
    rows = of(spark, sf_dir, "replies").withColumn("p", replies.parsed(F.col("reply")))
    return rows.select("event_id", *replies.judgement(F.col("reply"), F.col("p")))


@query(
    REPLIES_SQL + """ select event_id, case form when 5 then user_id % 2 = 0 when 7 then true else false end as changed,
    case form when 0 then event_type when 1 then event_type when 5 then event_type end as change_type,
    case form when 0 then concat('d', user_id) when 2 then 'no type' end as description from replies"""
)
def raw_reply_parse(spark, sf_dir):
    rows = of(spark, sf_dir, "replies").withColumn("p", replies.parsed(F.col("reply")))
    return rows.select("event_id", *replies.raw_verdict(F.col("p"))).drop("region")


@query("select page_id, sha256(concat(url, html)) as plain, sha256(concat(url, html, case when page_id % 2 = 0 then 'rect' else '' end)) as with_context from pages")
def cache_key(spark, sf_dir):
    context = F.when(F.col("page_id") % 2 == 0, "rect")
    return _table(spark, sf_dir, "pages").select("page_id", cache.content_key(F.col("url"), F.col("html")).alias("plain"), cache.content_key(F.col("url"), F.col("html"), context).alias("with_context"))


_ENTRIES = ", entries as (select key, max(asked) as cached_at from requests where id % 2 = 0 group by key)"


@query(cte("requests") + _ENTRIES + f" select id, key, coalesce(epoch_ms({NOW}) - epoch_ms(cached_at) <= {cache.TTL_MS}, false) as hit from requests left join entries using (key)")
def cache_ttl_probe(spark, sf_dir):
    log = of(spark, sf_dir, "requests")
    entries = cache.latest(log.where("id % 2 = 0").select("key", F.lit("c").alias("classification"), F.col("asked").alias("cached_at")))
    return cache.probe(log.select("id", "key"), entries, F.expr(NOW)).select("id", "key", "hit")


@query(
    cte("requests").replace("with ", "with recursive ", 1) + f""", anchors as (select key, min(epoch_ms(asked)) as t from requests group by key
    union all select * from (select a.key, (select min(epoch_ms(r.asked)) from requests r where r.key = a.key and epoch_ms(r.asked) > a.t + {cache.TTL_MS}) as t from anchors a) where t is not null)
select key, count(*) as requests, count(*) - (select count(*) from anchors a where a.key = r.key) as hits from requests r group by key"""
)
def cache_replay(spark, sf_dir):
    return cache.replay(of(spark, sf_dir, "requests").withColumnRenamed("asked", "at")).groupBy("key").agg(F.count("*").alias("requests"), F.count_if("hit").alias("hits"))


@query(cte("results") + f", {PRICES_SQL} select pair_id, round(coalesce(input_tokens / 1e6 * pi + output_tokens / 1e6 * po, 0), 9) as cost_usd from results left join prices using (model)")
def cost_per_pair(spark, sf_dir):
    out = cost.with_cost(of(spark, sf_dir, "results"), cost.pricing(spark, PRICES))
    return out.select("pair_id", F.round("cost_usd", 9).alias("cost_usd"))


_KNOWN = "case when known then kind end"


@query(
    cte("results") + f""", {PRICES_SQL}, c as (select *, coalesce(input_tokens / 1e6 * pi + output_tokens / 1e6 * po, 0) as cost, {_KNOWN} as truth from results left join prices using (model)),
s as (select count(*) filter (where truth is distinct from 'none') as changed_count, count(*) filter (where truth = 'none') as none_count, count(*) filter (where cached) as cache_hits,
    count(*) filter (where not cached) as cache_misses, sum(cost) filter (where cached is distinct from true) as cost_usd from c)
select changed_count, none_count, cache_hits, cache_misses, round(cost_usd, 6) as cost_usd, round(cost_usd / cache_misses * cache_hits, 6) as saved_usd from s"""
)
def report_summary(spark, sf_dir):
    r = of(spark, sf_dir, "results")
    out = cost.report_summary(r.where("known").select(F.col("pair_id").alias("id"), "kind"), r.drop("kind"), cost.pricing(spark, PRICES))
    return out.withColumn("cost_usd", F.round("cost_usd", 6)).withColumn("saved_usd", F.round("saved_usd", 6))


def _iou_sql(dx: str, dy: str) -> str:
    shared = f"greatest(least(x + {dx} + w, tx + tw) - greatest(x + {dx}, tx), 0) * greatest(least(y + {dy} + h, ty + th) - greatest(y + {dy}, ty), 0)"
    return f"({shared}) / (w * h + tw * th - {shared})"


#: Regions of a result as (dx, dy) beside its rectangle, by pair_id % 4: none, one, and several of which none, one or more may hit.
REGIONS = {0: [], 1: [(0.0, 0.0)], 2: [(500.0, 0.0), (11.0, 0.0)], 3: [(0.0, 9.0), (6.0, 0.0), (0.0, 0.0)]}
_HIT = "case pair_id % 4 " + " ".join(f"when {k} then " + (" or ".join(f"{_iou_sql(f'{dx}e0', f'{dy}e0')} >= 0.3e0" for dx, dy in v) or "false") for k, v in REGIONS.items()) + " end"

SCORES = _RESULTS + f""", m as (select *, {_KNOWN} as truth, {_HIT} as struck from scored), s as (select baseline, count(*) as n,
    count(*) filter (where truth <> 'none') as real, count(*) filter (where truth = 'none') as none, count(*) filter (where truth <> 'none' and changed) as tp,
    count(*) filter (where truth = 'none' and changed) as fp, count(*) filter (where truth <> 'none' and changed and struck) as hit,
    count(*) filter (where truth <> 'none' and changed and change_type is not null) as typed, count(*) filter (where truth <> 'none' and changed and change_type = truth) as correct,
    sum(input_tokens) filter (where known) as ti, sum(output_tokens) filter (where known) as tout from m group by baseline) """


def regions_of(r: DataFrame) -> DataFrame:
    """Results with ``regions``: 0 to 3 rectangles."""
    lists = [F.array(*(F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), "w", "h") for dx, dy in v)) for v in REGIONS.values()]
    of_pair = F.when(F.col("pair_id") % 4 == 1, lists[1]).when(F.col("pair_id") % 4 == 2, lists[2]).when(F.col("pair_id") % 4 == 3, lists[3])
    return r.withColumn("regions", F.coalesce(of_pair, F.filter(lists[1], lambda _: F.lit(False))))


def summary(spark, sf_dir):
    r = of(spark, sf_dir, "results")
    truth = r.where("known").select(F.col("pair_id").alias("id"), "kind", F.struct(*(F.col(f"t{c}").alias(c) for c in "xywh")).alias("truth"))
    return metrics.summarize(truth, regions_of(r).drop("kind"))


@query(
    SCORES + """select baseline, n, round(tp / real, 9) as recall, round(hit / tp, 9) as region_precision, round(fp / none, 9) as false_positive_rate, round(correct / typed, 9) as type_accuracy,
    round(ti / n, 6) as avg_input_tokens, round(tout / n, 6) as avg_output_tokens from s"""
)
def metrics_summary(spark, sf_dir):
    out = summary(spark, sf_dir)
    rates = [F.round(c, 9).alias(c) for c in ("recall", "region_precision", "false_positive_rate", "type_accuracy")]
    return out.select("baseline", "n", *rates, *(F.round(c, 6).alias(c) for c in ("avg_input_tokens", "avg_output_tokens")))


@query(SCORES + "select baseline, round(correct / real, 9) as end_to_end_accuracy from s")
def end_to_end_accuracy(spark, sf_dir):
    return summary(spark, sf_dir).select("baseline", F.round("end_to_end_accuracy", 9).alias("end_to_end_accuracy"))


@query("select round(avg(coalesce(cast(quality * 3 + 2 as double), 1)), 9) as average_score, count(*) as n from documents left join labels using (doc_id)")
def judge_average(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id").join(_table(spark, sf_dir, "labels"), "doc_id", "left")
    return metrics.average_score(rows.select(F.coalesce(F.col("quality") * 3 + 2, F.lit(1)).alias("score"))).withColumn("average_score", F.round("average_score", 9))


@query(cte("results") + " select input_tokens % 50 as pair_id, cast(sum(input_tokens) as bigint) as input_tokens, cast(sum(output_tokens) as bigint) as output_tokens, bool_and(cached) as cached from results group by all")
def pair_tokens_cached(spark, sf_dir):
    return metrics.pair_usage(of(spark, sf_dir, "results").withColumn("pair_id", F.col("input_tokens") % 50))


@query(
    cte("results") + f""", {PRICES_SQL}, s as (select model, cast(sum(input_tokens) as bigint) as input_tokens, cast(sum(output_tokens) as bigint) as output_tokens from results group by model)
select model, input_tokens, output_tokens, floor(coalesce(input_tokens / 1e6 * pi + output_tokens / 1e6 * po, 0) * 10000 + 0.5e0) / 10000 as cost_usd from s left join prices using (model)"""
)
def run_cost(spark, sf_dir):
    return cost.run_cost(of(spark, sf_dir, "results").select("model", "input_tokens", "output_tokens"), cost.pricing(spark, PRICES))


_LAST_BOX = "(select pair_id, " + ", ".join(f"max_by({{0}}.{c}, ord) as {{1}}{c}" for c in "xywh") + " from {0} group by pair_id)"


@query(
    _DOM + ", last as " + _LAST_BOX.format("dom_after", "l") + ", old as " + _LAST_BOX.format("dom_before", "o")
    + ", box as (select pair_id, min(x) as x, min(y) as y, max(x + w) - min(x) as w, max(y + h) - min(y) as h from dom_before group by pair_id), t as (select *, case pair_id % 13 "
    + " ".join(f"when {i} then '{k}'" for i, k in enumerate(KINDS)) + " end as kind from box join old using (pair_id) left join last using (pair_id)) select pair_id, "
    + ", ".join(f"case kind when 'none' then null when 'element-remove' then o{c} when 'element-add' then l{c} else {c} end as {c}" for c in "xywh") + " from t"
)
def ground_truth_rect(spark, sf_dir):
    before, after = of(spark, sf_dir, "dom_before"), of(spark, sf_dir, "dom_after")
    rect = F.struct(*"xywh")
    box = F.struct(F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"), (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h"))
    t = before.groupBy("pair_id").agg(box.alias("box"), F.max_by(rect, "ord").alias("old"))
    t = t.join(after.groupBy("pair_id").agg(F.max_by(rect, "ord").alias("last")), "pair_id", "left")
    t = t.join(of(spark, sf_dir, "pairs").withColumnRenamed("id", "pair_id").select("pair_id", "kind"), "pair_id")
    return t.select("pair_id", mutate.truth_rect(F.col("kind"), F.col("old"), F.col("last"), F.col("box")).alias("r")).select("pair_id", "r.*")


@query(
    _DOM + """select pair_id, path, concat('Name the kind of visual change between two crops of a page as JSON with changeType, description and confidence.',
    case when pair_id % 4 = 0 then '' else concat(' The DOM reports changes in: ', replace(changed_fields, ',', ', '), case when pair_id % 2 = 0 then '' else concat(' of #', id) end, '.') end) as prompt from changes"""
)
def hint_prompt(spark, sf_dir):
    hinted = _changes(spark, sf_dir).withColumn("hint", classify.hint(F.col("pair_id") % 4 != 0, F.col("changed_fields"), F.when(F.col("pair_id") % 2 == 0, "").otherwise(F.col("id"))))
    return hinted.select("pair_id", "path", text.prompt(F.col("hint.fields"), F.col("hint.id")).alias("prompt"))


@query(
    cte("results") + """ select case when kind = 'none' and changed then 'false positive' when kind = 'none' then 'ok' when changed and coalesce(change_type = kind, false) then 'detected, right type'
    when changed then 'detected, wrong type' else 'missed' end as status, count(*) as n from results group by all"""
)
def status_labels(spark, sf_dir):
    right = F.coalesce(F.col("change_type") == F.col("kind"), F.lit(False))
    return of(spark, sf_dir, "results").select(metrics.status(F.col("kind") != "none", F.col("changed"), right).alias("status")).groupBy("status").agg(F.count("*").alias("n"))


@query("""select page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') as escaped from pages""")
def html_escape(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", text.html_escape(F.col("html")).alias("escaped"))


@query("select n.place, n.id, o.n_nationkey as key from (select * from (values (0, 7), (1, 3), (2, 11)) v(place, id)) n join nation o on o.n_nationkey = n.id")
def subset_select(spark, sf_dir):
    known = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_nationkey").alias("key"))
    return pairs.subset(known, ["7", "3", "11"]).select("place", F.col("id").cast("int").alias("id"), "key")


@query("select n_nationkey as id from nation where n_nationkey in (3, 7)")
def subset_present(spark, sf_dir):
    known = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id"))
    return pairs.subset_if_present(known, ["3", "7", "999"]).select(F.col("id").cast("int").alias("id"))


@query(cte("dom_before") + " select pair_id, row_number() over (partition by pair_id order by ord) - 1 as ord, path, 'TR' as tag, id, null::varchar as class_name, text, x, y, w, h, color, background_color, font_weight, border_radius from dom_before")
def snapshot_parse(spark, sf_dir):
    """Nodes written as JSON snapshots and parsed back."""
    style = F.struct("color", F.col("background_color").alias("backgroundColor"), F.col("font_weight").alias("fontWeight"), F.col("border_radius").alias("borderRadius"))
    node = F.struct("ord", F.struct("path", F.lit("TR").alias("tag"), "id", "text", F.struct("x", "y", "w", "h").alias("rect"), style.alias("style")).alias("n"))
    shots = of(spark, sf_dir, "dom_before").groupBy("pair_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(node)), lambda s: s["n"])).alias("dom"))
    return domdiff.parse_snapshot(shots, "dom")


@query()
def page_dom_nodes(spark, sf_dir):
    return html_dom.page_nodes(_table(spark, sf_dir, "pages"))


@query(
    SCORES + """select baseline, concat_ws(', ', printf('recall %.1f%%', tp / real * 100), printf('region_precision %.1f%%', hit / tp * 100), printf('false_positive_rate %.1f%%', fp / none * 100),
    printf('type_accuracy %.1f%%', correct / typed * 100), printf('tokens %.0f', ti / n)) as line from s"""
)
def metrics_report(spark, sf_dir):
    return report.metric_lines(summary(spark, sf_dir))


#: Size of the screenshots that stand for suppliers.
WIDE, TALL = 96, 64
SHOTS = f"""with s as (select s_suppkey as pair_id, s_suppkey % 7 = 0 as quiet, s_suppkey % 3 = 0 as pixels_only, s_suppkey % 5 = 0 as twice,
    5 + s_suppkey % 40 as x, 4 + s_suppkey % 30 as y, 10 + s_suppkey % 20 as w, 8 + s_suppkey % 12 as h from supplier)"""


def shots(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes before and after, and images, of a supplier each: a box that turns up, a speck below the least share, a node that only the DOM moves."""
    k = F.col("s_suppkey")
    s = _table(spark, sf_dir, "supplier").select(k.alias("pair_id"), (k % 7 == 0).alias("quiet"), (k % 3 == 0).alias("pixels_only"), (k % 5 == 0).alias("twice"), (5 + k % 40).alias("x"), (4 + k % 30).alias("y"), (10 + k % 20).alias("w"), (8 + k % 12).alias("h"))

    def node(path, x, y, w, h, background):
        style = [F.lit("t").alias("text"), F.lit("c").alias("color"), background.alias("background_color"), F.lit("400").alias("font_weight"), F.lit("0px").alias("border_radius")]
        return s.select("pair_id", "quiet", "pixels_only", "twice", F.lit(path).alias("path"), F.lit(len(path)).cast("bigint").alias("ord"), F.lit(path).alias("id"), *(F.lit(v).cast("double").alias(c) if isinstance(v, int) else v.cast("double").alias(c) for c, v in zip("xywh", (x, y, w, h), strict=True)), *style)

    plain, box, other = F.lit("#ffffff"), ("box", *(F.col(c) for c in "xywh")), ("aside", 80, 55, 4, 4)
    before = node(*box, plain).unionByName(node(*other, plain))
    turned = F.when(F.col("quiet") | F.col("pixels_only"), plain).otherwise(F.lit("#204080"))
    after = node(*box, turned).unionByName(node(*other, plain).withColumn("x", F.when(F.col("twice"), F.col("x") + 9.0).otherwise(F.col("x"))))

    def run(frames):
        for frame in frames:
            images = {"before": [], "after": []}
            for quiet, x, y, w, h in zip(*(frame[c] for c in ("quiet", *"xywh")), strict=True):
                rects = [] if quiet else [(x, y, w, h, "#204080"), (1, 60, 2, 2, "#000000")]
                images["before"].append(png.encode_png(mutate.painted([], WIDE, TALL)))
                images["after"].append(png.encode_png(mutate.painted(rects, WIDE, TALL)))
            yield frame[["pair_id"]].assign(**images)

    dealt = s.repartition(spark.sparkContext.defaultParallelism, "pair_id")  # few bytes that make large images
    return before, after, written(dealt.mapInPandas(run, "pair_id bigint, before binary, after binary"), "shots")


@query(
    SHOTS + """ select pair_id, x::double as x, y::double as y, w::double as w, h::double as h, 'dom+pixel' as source, 'backgroundColor' as changed_fields, 'box' as dom_id from s where not quiet and not pixels_only
    union all select pair_id, 89, 55, 4, 4, 'dom', 'rect', 'aside' from s where twice
    union all select pair_id, x, y, w, h, 'pixel', null, null from s where not quiet and pixels_only and twice"""
)
def detect_on_images(spark, sf_dir):
    """From snapshots and PNG screenshots to candidate regions."""
    regions, _ = fusion.detect(*shots(spark, sf_dir))
    return _flat(regions).drop("ord")


@query(SHOTS + " select pair_id, (case when quiet or pixels_only then 0 else 1 end + twice::int)::bigint as dom_change_count, not (quiet or pixels_only) or twice as changed, (not quiet)::bigint as pixel_region_count from s")
def detect_summary(spark, sf_dir):
    return fusion.detect(*shots(spark, sf_dir))[1]


class CropModel:
    """A model that answers with the size of the first image it is shown, and whether it got a hint."""

    def send(self, system: str, blocks: list[dict]) -> tuple[str, int, int]:
        first = next(b for b in blocks if b["type"] == "image")
        tall, wide = png.decode_png(base64.b64decode(first["data"])).shape[:2]
        hinted = "The DOM reports" in system
        return json.dumps({"changeType": "color-change" if hinted else "other", "description": f"{wide}x{tall}", "confidence": 0.5}), 10, 5


@query(
    SHOTS + """, r as (select pair_id, x, y, w, h, true as hinted from s where not quiet and not pixels_only union all select pair_id, 89, 55, 4, 4, true from s where twice
    union all select pair_id, x, y, w, h, false from s where not quiet and pixels_only and twice),
c as (select *, pair_id % 2 = 0 or x = 89 and exists (select 1 from s where quiet and twice and pair_id % 2 = 0) as early, greatest(x - 16, 0) as cx, greatest(y - 16, 0) as cy, row_number() over (partition by pair_id order by w * h desc) as rank from r),
k as (select *, least(96 - cx, w + 32) as cw, least(64 - cy, h + 32) as ch from c)
select pair_id, rank, case when hinted then 'color-change' else 'other' end as change_type, concat(cw, 'x', ch) as description, 0.5e0 as confidence,
    early as cached, case when early then 0 else 10 end::bigint as input_tokens, case when early then 0 else 5 end::bigint as output_tokens from k where rank = 1"""
)
def region_classification(spark, sf_dir):
    """The largest region of each pair cropped, keyed, looked up and, where it is new, asked; pairs of even ids were asked before.

    The node aside looks alike in all pairs, so one answer serves them all.
    """
    before, after, images = shots(spark, sf_dir)
    regions = fusion.detect(before, after, images)[0]
    now = F.expr(NOW)
    none = spark.createDataFrame([], "key string, classification struct<change_type:string,description:string,confidence:double>, cached_at timestamp")
    even = regions.where("pair_id % 2 = 0")
    _, entries = classify.classify_regions(even, images, none, CropModel, now, k=1)
    answered, _ = classify.classify_regions(regions, images, entries, CropModel, now, k=1)
    return answered.select("pair_id", F.col("rank").cast("bigint").alias("rank"), "change_type", "description", "confidence", "cached", "input_tokens", "output_tokens")


@query(REPLIES_SQL + """ select event_id as pair_id, case form when 5 then user_id % 2 = 0 when 7 then true else false end as changed, 0::bigint as n_regions,
    case form when 0 then event_type when 1 then event_type when 5 then event_type end as change_type, case form when 0 then concat('d', user_id) when 2 then 'no type' end as description,
    10::bigint as input_tokens, 5::bigint as output_tokens from replies""")
def raw_pair_arm(spark, sf_dir):
    said = of(spark, sf_dir, "replies").select(F.col("event_id").alias("key"), F.col("reply").alias("text"))
    pairs_ = said.select(F.col("key").alias("pair_id"))
    out = classify.raw_arm(pairs_, lambda rows: classify.scripted(rows.withColumn("key", F.col("pair_id")), said))
    return out.withColumn("regions", F.size("regions").cast("bigint")).withColumnRenamed("regions", "n_regions")


@query(_RESULTS + """, t as (select count(*) as total, count(*) filter (where kind <> 'none') as expected, count(*) filter (where changed) as detected, count(*) filter (where changed and kind = 'none') as false_positives,
    count(*) filter (where iou > 0.3e0) as strict_hits from scored)
select *, round(detected / expected, 9) as recall, round(false_positives / (total - expected), 9) as false_positive_rate from t""")
def detection_tallies(spark, sf_dir):
    r = of(spark, sf_dir, "results")
    counts = metrics.tallies(r.select((F.col("kind") != "none").alias("expected"), F.col("changed").alias("detected")))
    hits = r.select(F.struct(*"xywh").alias("p"), F.struct(*(F.col(f"t{c}").alias(c) for c in "xywh")).alias("t")).agg(F.count_if(metrics.strict_hit(F.col("p"), F.col("t"))).alias("strict_hits"))
    return counts.crossJoin(hits).withColumns({c: F.round(c, 9) for c in ("recall", "false_positive_rate")})  # one row and one row


@query(cte("results") + " select baseline, count(*) as n, cast(sum(case when kind = 'none' then 1 else 0 end) as bigint) as quiet from results where known group by baseline")
def matched_results(spark, sf_dir):
    r = of(spark, sf_dir, "results").where("known")
    pairs_ = r.select(F.col("pair_id").alias("id"), "kind").distinct()
    return metrics.matched(r.drop("kind"), pairs_).groupBy("baseline").agg(F.count("*").alias("n"), F.sum((F.col("kind") == "none").cast("bigint")).alias("quiet"))


@query(
    cte("results") + f""", {PRICES_SQL} select count(distinct pair_id) as total_pairs, count(*) as total_results, cast(sum(input_tokens) as bigint) as total_input, cast(sum(output_tokens) as bigint) as total_output,
    floor(sum(coalesce(input_tokens / 1e6 * pi + output_tokens / 1e6 * po, 0)) * 10000 + 0.5e0) / 10000 as cost_usd from results left join prices using (model)"""
)
def run_totals(spark, sf_dir):
    return report.run_totals(of(spark, sf_dir, "results"), cost.pricing(spark, PRICES))
