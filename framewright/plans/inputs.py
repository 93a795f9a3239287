"""Inputs of the queries, derived from the driver's tables in SQL that Spark and DuckDB both read.

``{lineitem}`` and the like stand for tables; ``of`` gives an input as a DataFrame, ``cte`` as the head of a query.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

KINDS = "spatial-shift spatial-shift color-change color-change size-change size-change text-change text-change element-add element-remove style-change style-change none".split()
_KIND = "case {0} % 13 " + " ".join(f"when {i} then '{k}'" for i, k in enumerate(KINDS)) + " end"

INPUTS = {
    # lineitem rows as nodes of a snapshot: a pair per order, a path per line, repeated paths among them
    "dom_before": """
        select l_orderkey as pair_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 as ord,
            concat('TR:', cast(l_linenumber as string)) as path, concat('n', cast(l_suppkey as string)) as id, l_returnflag as text,
            cast(l_partkey % 200 as double) as x, cast(l_linenumber * 40 as double) as y, floor(l_quantity) + 20.0e0 as w, cast(10 + l_suppkey % 40 as double) as h,
            concat('c', cast(cast(floor(l_tax * 100e0 + 0.5e0) as int) as string)) as color, concat('b', l_linestatus) as background_color,
            case when l_discount > 0.05e0 then '700' else '400' end as font_weight, concat(cast(l_suppkey % 5 as string), 'px') as border_radius, l_partkey % 13 as k
        from {lineitem}""",
    "dom_after": """
        select pair_id, ord + copy * 1048576 as ord, case when copy = 1 then concat(path, '+') else path end as path, id, case k when 6 then concat(text, ' (new)') when 7 then 'An entirely different and rather longer text' else text end as text,
            case k when 0 then x + 6e0 when 1 then x + 28e0 else x end as x, y,
            case k when 4 then floor(w * 1.1e0 + 0.5e0) when 5 then floor(w * 1.35e0 + 0.5e0) else w end as w,
            case k when 4 then floor(h * 1.1e0 + 0.5e0) when 5 then floor(h * 1.35e0 + 0.5e0) else h end as h, color,
            case k when 2 then '#3b6fe0' when 3 then '#dc2626' else background_color end as background_color,
            case k when 10 then '400' else font_weight end as font_weight, case k when 11 then '0px' else border_radius end as border_radius
        from dom_before cross join (values (0), (1)) as c(copy) where k <> 9 and (copy = 0 or k = 8)""",
    "pairs": f"select o_orderkey as id, {_KIND.format('o_orderkey')} as kind, o_orderkey % 3 as fixture from {{orders}}",
    # boxes that stand for pixel regions, a few per pair
    "boxes": """
        select l_orderkey as pair_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) - 1 as ord,
            l_suppkey * 7 % 200 as x, cast(l_linenumber as bigint) * 40 + l_partkey % 60 as y, 10 + l_partkey % 30 as w, 5 + l_suppkey % 30 as h, 1 + l_partkey % 100 as changed_pixels
        from {lineitem}""",
    "requests": "select event_id as id, concat(event_type, ':', cast(user_id as string)) as key, ts as asked from {events}",
    "replies": """
        select event_id, case event_id % 8
            when 0 then concat('{{"changeType":"', event_type, '","description":"d', cast(user_id as string), '","confidence":0.5}}')
            when 1 then concat('```json', chr(10), '{{"changeType":"', event_type, '","confidence":1}}', chr(10), '```')
            when 2 then '{{"description":"no type","confidence":"0.9"}}'
            when 3 then concat(' not json ', event_type, ' ')
            when 4 then 'null'
            when 5 then concat('{{"changed":', case when user_id % 2 = 0 then 'true' else '""' end, ',"type":"', event_type, '","score":', cast(user_id % 9 as string), ',"rationale":"r"}}')
            when 6 then concat('```', chr(10), '{{"changeType":"x"}}', chr(10), '```')
            else concat('{{"changed":"false","score":', cast(user_id % 7 as string), '.5}}') end as reply,
            event_id % 8 as form, event_type, user_id
        from {events}""",
    "results": f"""
        select event_id as pair_id, concat('arm', cast(user_id % 3 as string)) as baseline, {_KIND.format('event_id')} as kind, event_id % 17 <> 0 as known,
            user_id % 5 <> 0 as changed, case when user_id % 4 = 0 then null when user_id % 4 = 1 then 'text-change' else {_KIND.format('event_id')} end as change_type,
            cast(event_id % 50 as double) as x, cast(user_id % 40 as double) as y, cast(20 + event_id % 9 as double) as w, cast(15 + user_id % 11 as double) as h,
            cast(event_id % 50 + event_id % 6 as double) as tx, cast(user_id % 40 + 2 as double) as ty, 22e0 as tw, 18e0 as th,
            cast(floor(abs(value)) as bigint) as input_tokens, cast(5 + event_id % 20 as bigint) as output_tokens, concat('model-', cast(event_id % 6 as string)) as model,
            case when event_id % 3 = 0 then null else event_id % 3 = 1 end as cached
        from {{events}}""",
}
NEEDS = {"dom_after": ["dom_before"]}


def tables_of(text: str) -> list[str]:
    return sorted(set(re.findall(r"(?<!\{)\{(\w+)\}", text)))


def of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The input's rows.  Rows that a window numbers are dealt out by its key as they are read, before anything is derived from them, so inputs of one table share these few columns' shuffle."""
    text = INPUTS[name]
    for inner in NEEDS.get(name, []):
        text = f"with {inner} as ({INPUTS[inner]}) {text}"
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables_of(text)}
    for key in set(re.findall(r"partition by (\w+)", text)):
        tables = {t: df.repartition(key) if key in df.columns else df for t, df in tables.items()}
    return spark.sql(text, **tables)


def cte(*names: str) -> str:
    """``with`` and the named inputs, and those they need, as DuckDB reads them."""
    order: list[str] = []
    for name in names:
        order += [n for n in [*NEEDS.get(name, []), name] if n not in order]
    parts = [f"{n} as ({INPUTS[n].format(**{t: t for t in tables_of(INPUTS[n])})})" for n in order]
    return "with " + ", ".join(parts)
