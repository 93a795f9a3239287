"""HTML pages to DOM node rows: every descendant of body with its positional path."""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements without an end tag, and elements whose start ends an open paragraph.
VOID = "area base br col embed hr img input link meta source track wbr".split()
ENDS_PARAGRAPH = "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
NODES = "page_id bigint, ord int, path string, tag string, id string, class_name string, text string"

_NAMES = ["page_id", "ord", "path", "tag", "id", "class_name", "text"]
_KINDS = [pa.int64(), pa.int32(), *[pa.string()] * 5]

#: Names that start or end a text of other rules, in some version of the parser at least, and those of them that hold plain text till their end.
UNPLAIN = frozenset("script style iframe noembed noframes noscript xmp plaintext svg math".split())
PLAIN_TEXT = frozenset(("textarea", "title"))
_VOID, _ENDS_PARAGRAPH = frozenset(VOID), frozenset(ENDS_PARAGRAPH)
_ATTRIBUTE = r"""[ \t\n\r\f]+[a-zA-Z][a-zA-Z0-9_-]*(?:="[^"<>]*"|=[a-zA-Z0-9_.-]+(?=[ \t\n\r\f>])|(?=[ \t\n\r\f/>]))"""
#: Plain markup: a tag of plain attributes, an end tag, the document's type, or text.
_TOKEN = re.compile(rf"<([a-zA-Z][a-zA-Z0-9]*)((?:{_ATTRIBUTE})*)[ \t\n\r\f]*(/?)>|</([a-zA-Z][a-zA-Z0-9]*)[ \t\n\r\f]*>|(<!(?i:doctype) [a-zA-Z]+>)|([^<]+)")
_PAIR = re.compile(r"""([a-zA-Z][a-zA-Z0-9_-]*)(?:="([^"]*)"|=([a-zA-Z0-9_.-]+))?""")


class _Walk(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[dict] = []
        self.nodes: list[dict] = []
        self.inside, self.top = False, 0

    def handle_starttag(self, tag, attrs):
        if tag == "body":
            self.inside = True
            return
        if tag in ("html", "head") or not self.inside:
            return
        if tag in ENDS_PARAGRAPH and any(n["tag"] == "P" for n in self.open):
            self.handle_endtag("p")
        if tag == "li" and self.open and self.open[-1]["tag"] == "LI":
            self.handle_endtag("li")
        above = self.open[-1] if self.open else None
        place = above["children"] if above else self.top
        if above:
            above["children"] += 1
        else:
            self.top += 1
        known = {k: v or "" for k, v in attrs}
        step = f"{tag.upper()}:{place}"
        node = {"path": f"{above['path']}>{step}" if above else step, "tag": tag.upper(), "id": known.get("id", ""), "class": known.get("class", ""), "value": known.get("value", ""), "children": 0, "words": []}
        self.nodes.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag == "body":
            self.inside = False
        names = [n["tag"] for n in self.open]
        if tag.upper() in names:
            del self.open[len(names) - 1 - names[::-1].index(tag.upper()) :]

    def handle_data(self, data):
        for node in self.open:
            node["words"].append(data)


def _text(node: dict) -> str:
    """The value of a field, the trimmed text of a leaf, nothing of others."""
    if node["tag"] in ("INPUT", "TEXTAREA"):
        return node["value"] or ("".join(node["words"]) if node["tag"] == "TEXTAREA" else "")
    return "".join(node["words"]).strip() if not node["children"] else ""


def _plain_nodes(html: str) -> list[tuple] | None:
    """What ``_Walk`` finds, without its parser; None for pages that aren't plain markup all through."""
    nodes: list[tuple | list] = []  # a list until it is known what an element's text is
    open_: list[list] = []  # [path, tag, children, place, words]
    inside, top, at, within = False, 0, 0, ""

    def close(many: int) -> None:
        for path, tag, children, place, words in open_[many:]:
            i, known = nodes[place]
            text = known.get("value") or "".join(words) if tag == "TEXTAREA" else "" if children else "".join(words).strip()
            nodes[place] = (i, path, tag, known.get("id", ""), known.get("class", ""), text)
        del open_[many:]

    for token in _TOKEN.finditer(html):
        if token.start() != at:
            return None
        at = token.end()
        start, attributes, slash, end, doctype, text = token.groups()
        if text is not None:
            if open_:  # all below the last one have children, so no text of their own
                open_[-1][4].append(unescape(text) if "&" in text else text)
            continue
        if doctype is not None:
            if within:
                return None
            continue
        name = (start or end).lower()
        if name in UNPLAIN or within and not (end and name == within):
            return None
        tag = name.upper()
        if end:
            within = ""
            if name == "body":
                inside = False
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][1] == tag:
                    close(k)
                    break
            continue
        if name in PLAIN_TEXT:
            if slash:
                return None
            within = name
        if name == "body":
            inside = True
            continue
        if not inside or name == "html" or name == "head":
            continue
        if name in _ENDS_PARAGRAPH:
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][1] == "P":
                    close(k)
                    break
        if name == "li" and open_ and open_[-1][1] == "LI":
            close(len(open_) - 1)
        if open_:
            above = open_[-1]
            path = f"{above[0]}>{tag}:{above[2]}"
            above[2] += 1
        else:
            path = f"{tag}:{top}"
            top += 1
        known = {k.lower(): unescape(v or w) for k, v, w in _PAIR.findall(attributes)} if attributes else {}
        if name in _VOID:
            nodes.append((len(nodes), path, tag, known.get("id", ""), known.get("class", ""), known.get("value", "") if name == "input" else ""))
        else:
            open_.append([path, tag, 0, len(nodes), []])
            nodes.append([len(nodes), known])
    if at != len(html) or within:
        return None
    close(0)
    return nodes


def html_nodes(html: str | None) -> list[tuple]:
    html = html if html and "<body" in html.lower() else f"<body>{html or ''}"
    plain = _plain_nodes(html)
    if plain is not None:
        return plain
    walk = _Walk()
    walk.feed(html)
    walk.close()
    return [(i, n["path"], n["tag"], n["id"], n["class"], _text(n)) for i, n in enumerate(walk.nodes)]


def page_nodes(pages: DataFrame) -> DataFrame:
    """NODES of (page_id, html); a null or empty page has none."""

    def run(batches):
        for batch in batches:
            rows = [(p, *n) for p, h in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist(), strict=True) for n in html_nodes(h)]
            columns = zip(*rows, strict=True) if rows else [()] * len(_NAMES)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, _KINDS, strict=True)], names=_NAMES)

    return pages.select(F.col("page_id").cast("bigint"), "html").mapInArrow(run, NODES)
