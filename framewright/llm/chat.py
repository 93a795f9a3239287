"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with offsets, and its mask is the intersection of two sorted
lists by binary search: the spans of assistant texts and the spans of tokens.  Turns stand between marks that
are single tokens, so no token reaches over a text's edge.  Marks, and the control strings of other common
templates, are escaped inside texts: a backslash after their first character, one more if there are some.

A conversation is one rendering.  One longer than SEGMENT characters is held in several rows, each of whole turns, so
that no task holds a conversation of any length; every row says where its turns, characters and tokens begin in the
rendering, and marks are single tokens, so the rows' tokens in order are the tokens of the whole.
"""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import bounded_batches

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
SEGMENT = 1 << 18
#: What may not stand in a text as it is: any "<|", and the marks </s>, <s>, [INST], [/INST].
_CONTROL = r"(\||/?s>|/?INST\])"
_RAW, _ESCAPED = re.compile(r"([<\[])(\\*)" + _CONTROL), re.compile(r"([<\[])\\(\\*)" + _CONTROL)
_TURNS = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.DOTALL)

FORMATTED = "conv_id long, segment int, first_turn long, first_char long, first_token long, n_turns long, formatted string, input_ids array<int>, token_start array<int>, token_end array<int>, loss_mask array<boolean>"


def escape(text: str) -> str:
    return _RAW.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def render(turns: list[tuple[str, str]], trained: str = "assistant") -> tuple[str, np.ndarray]:
    """The formatted text and the sorted spans, in code points, of the texts of role ``trained``."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = TURN + escape(role) + TEXT, escape(text)
        if role == trained and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), np.array(spans, np.int64).reshape(-1, 2)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) that ``render`` was given."""
    return [(unescape(r), unescape(t)) for r, t in _TURNS.findall(formatted)]


def loss_mask(spans: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which tokens lie in a span, each token's span found by binary search."""
    if not len(spans):
        return np.zeros(len(start), bool)
    at = np.searchsorted(spans[:, 0], start, "right") - 1
    return (at >= 0) & (start < spans[at, 1]) & (end > start)


def masked_texts(formatted: str, start: np.ndarray, end: np.ndarray, mask: np.ndarray) -> list[str]:
    """The unescaped texts under the mask; neighbours under it belong to one text."""
    edge = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
    return [unescape(formatted[start[a] : end[b - 1]]) for a, b in edge.reshape(-1, 2).tolist()]


_tools: dict[str, object] = {}


def _tool(path: str):
    if path not in _tools:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import AddedToken, Tokenizer

        _tools[path] = Tokenizer.from_file(path)
        _tools[path].add_special_tokens([AddedToken(m, normalized=False, special=True) for m in (TURN, TEXT, END)])
    return _tools[path]


def format_conversations(rows: DataFrame, tokenizer: str) -> DataFrame:
    """FORMATTED rows, one for each segment of each conversation, from (conv_id, turn, role, text).

    Token offsets and the mask are the segment's own; first_turn, first_char and first_token are its place in the conversation.

    Turns stand in the order of turn, then role, then text, nulls first; null roles and texts are empty; rows
    of a null conv_id form one conversation; repeated rows are turns of their own.  Segments of a conversation
    are consecutive rows of one partition.  An empty table gives an empty table; other columns are ignored.
    """
    bounded_batches(rows.sparkSession)
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        tool = _tool(tokenizer)

        def formatted(name, segment, place, turns):
            text, spans = render(turns)
            tokens = tool.encode(text, add_special_tokens=False)
            where = np.array(tokens.offsets, np.int32).reshape(-1, 2)
            mask = loss_mask(spans, where[:, 0], where[:, 1])
            row = (name, segment, *place, len(turns), text, tokens.ids, where[:, 0], where[:, 1], mask)
            place[:] = [place[0] + len(turns), place[1] + len(text), place[2] + len(where)]
            return row

        def batch_of(out):
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int64(), pa.int32(), *(4 * [pa.int64()]), pa.string(), *(3 * [pa.list_(pa.int32())]), pa.list_(pa.bool_())))],
                names=[f.split()[0] for f in FORMATTED.split(", ")],
            )

        now, segment, place, turns, size, out, held = None, 0, [0, 0, 0], [], 0, [], 0
        for batch in batches:
            for name, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if turns and ((name,) != now or size > SEGMENT):
                    out.append(formatted(now[0], segment, place, turns))
                    segment, turns, held, size = segment + 1, [], held + size, 0
                    if held > SEGMENT:
                        yield batch_of(out)
                        out, held = [], 0
                if (name,) != now:
                    now, segment, place = (name,), 0, [0, 0, 0]
                turns.append((role or "", text or ""))
                size += len(text or "")
        if turns:
            out.append(formatted(now[0], segment, place, turns))
        if out:
            yield batch_of(out)

    return dealt.select("conv_id", "role", "text").mapInArrow(run, FORMATTED)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(formatted: DataFrame) -> DataFrame:
    """What ``format_conversations`` wrote, read back from it segment by segment: one row for each conversation."""

    def run(batches):
        now, row = None, None

        def done():
            return pa.RecordBatch.from_pylist([{"conv_id": now[0], "n_turns": row[0], "turns_sha256": row[1].hexdigest(), "loss_chars": row[2], "loss_sha256": row[3].hexdigest(), "formatted_chars": row[4]}], schema)

        schema = pa.schema([(f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in DIGEST.split(", ")])
        for batch in batches:
            for i, name in enumerate(batch.column("conv_id").to_pylist()):
                if (name,) != now:
                    if row:
                        yield done()
                    now, row = (name,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                text = batch.column("formatted")[i].as_py()
                turns = parse(text)
                start, end, mask = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("token_start", "token_end", "loss_mask"))
                loss = "".join(masked_texts(text, start, end, mask))
                row[0] += len(turns)
                row[1].update("".join(f"{r}\n{t}\n" for r, t in turns).encode())
                row[2] += len(loss)
                row[3].update(loss.encode())
                row[4] += len(text)
        if row:
            yield done()

    return formatted.mapInArrow(run, DIGEST)
