"""Text and formatting expressions of reports and prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What HTML needs escaped, the ampersand first.
HTML_ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")]


def html_escape(c: Column) -> Column:
    for raw, safe in HTML_ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def percent(c: Column) -> Column:
    return F.format_string("%.1f%%", c * 100)


def fixed(c: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", c)


def iso_time(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSX")


def data_uri(content: Column, mime: str = "image/png") -> Column:
    """A data URI without the line breaks that base64 puts in."""
    return F.concat(F.lit(f"data:{mime};base64,"), F.regexp_replace(F.base64(content), r"[\r\n]", ""))


def prompt(fields: Column, node_id: Column) -> Column:
    """The system prompt of a region, with what the DOM says has changed where there is a hint."""
    base = F.lit("Name the kind of visual change between two crops of a page as JSON with changeType, description and confidence.")
    of = F.when(F.coalesce(node_id, F.lit("")) != "", F.concat(F.lit(" of #"), node_id)).otherwise("")
    hint = F.concat(F.lit(" The DOM reports changes in: "), F.array_join(fields, ", "), of, F.lit("."))
    return F.concat(base, F.coalesce(hint, F.lit("")))
