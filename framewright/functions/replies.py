"""Parsing of model replies: strict JSON behind an optional ``json`` fence, with the defaults that scoring relies on."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as JavaScript trims it.
_WHITE = r"\s\x{00A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{000B}"
_PARSED = "ok boolean, isnull boolean, changed boolean, type string, description string, confidence double, score double, rationale string, rx double, ry double, rw double, rh double"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A[{_WHITE}]+|[{_WHITE}]+\z", "")


def unfenced(c: Column) -> Column:
    """Trimmed, without an opening ``json`` fence (in any case) and a closing one; a bare opening fence stays."""
    return trimmed(F.regexp_replace(F.regexp_replace(trimmed(c), rf"\A```(?i:json)[{_WHITE}]*", ""), r"```\z", ""))


def _refuse(name: str):
    raise ValueError(name)


def _number(value) -> float | None:
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None


def _text(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    return str(value) if isinstance(value, (int, float)) else json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def truthy(value) -> bool:
    """As JavaScript's ``!!``: all strings but the empty one, all numbers but 0 and NaN, all arrays and objects."""
    if isinstance(value, (dict, list)):
        return True
    return bool(value) and not (isinstance(value, float) and math.isnan(value))


def _parse(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        try:
            value = json.loads(text if text is not None else "", parse_constant=_refuse)
        except (ValueError, RecursionError):
            rows.append((False, False, False, *(None,) * 9))
            continue
        if value is None:  # its fields can't be read
            rows.append((False, True, False, *(None,) * 9))
            continue
        get = value.get if isinstance(value, dict) else lambda _: None
        region = get("region") if isinstance(get("region"), dict) else {}
        kind = get("changeType") if get("changeType") is not None else get("type")
        rows.append(
            (True, False, truthy(get("changed")), _text(kind), _text(get("description")), _number(get("confidence")), _number(get("score")), _text(get("rationale")), *(_number(region.get(c)) for c in ("x", "y", "w", "h")))
        )
    return pd.DataFrame(rows, columns=[f.split()[0] for f in _PARSED.split(", ")])


def parsed(reply: Column) -> Column:
    """A struct of the fields of a reply; ``ok`` is false where it isn't strict JSON, or is null."""
    return F.pandas_udf(_parse, _PARSED)(unfenced(reply))


def classification(reply: Column, p: Column) -> list[Column]:
    """change_type, description, confidence: of a broken reply ``other``, its trimmed text and 0."""
    ok = p["ok"]
    return [
        F.when(ok, F.coalesce(p["type"], F.lit("other"))).otherwise("other").alias("change_type"),
        F.when(ok, F.coalesce(p["description"], F.lit(""))).otherwise(trimmed(reply)).alias("description"),
        F.when(ok, F.coalesce(p["confidence"], F.lit(0.0))).otherwise(0.0).alias("confidence"),
    ]


def judgement(reply: Column, p: Column) -> list[Column]:
    """score from 1 to 5, 1 without a number, and rationale; of a broken reply 1 and its first 100 characters."""
    score = F.least(F.lit(5), F.greatest(F.lit(1), F.floor(p["score"] + F.lit(0.5)))).cast("int")
    return [
        F.when(p["ok"] & p["score"].isNotNull(), score).otherwise(1).alias("score"),
        F.when(p["ok"], F.coalesce(p["rationale"], F.lit(""))).otherwise(F.substring(trimmed(reply), 1, 100)).alias("rationale"),
    ]


def raw_verdict(p: Column) -> list[Column]:
    """changed, type, description and region of a reply about a whole pair; a broken one says not changed."""
    ok = p["ok"]
    return [
        F.when(ok, p["changed"]).otherwise(False).alias("changed"),
        F.when(ok, p["type"]).alias("change_type"),
        F.when(ok, p["description"]).alias("description"),
        F.when(ok & p["rx"].isNotNull(), F.struct(p["rx"].alias("x"), p["ry"].alias("y"), p["rw"].alias("w"), p["rh"].alias("h"))).alias("region"),
    ]
