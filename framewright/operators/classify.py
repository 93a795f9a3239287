"""Classification of regions by a model: crops, prompts, providers and the three arms of an evaluation."""

from __future__ import annotations

import base64
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import replies, text
from ..functions.geometry import PADDING
from ..sources.png import decode_png, encode_png
from ..sources.shared import written
from . import cache
from .fusion import TOP_REGIONS, top_regions
from .metrics import pair_usage


class Provider(Protocol):
    """A model behind an API: system prompt and content blocks in; text and the tokens of prompt and answer out."""

    def send(self, system: str, blocks: list[dict]) -> tuple[str, int, int]: ...


def text_block(text: str) -> dict:
    return {"type": "text", "text": text}


def image_block(content: bytes, mime: str = "image/png") -> dict:
    return {"type": "image", "mime": mime, "data": base64.b64encode(content).decode("ascii")}


def system_field_request(model: str, system: str, blocks: list[dict], limit: int = 2048) -> dict:
    """A request with the system prompt in a field of its own."""
    content = [b if b["type"] == "text" else {"type": "image", "source": {"type": "base64", "media_type": b["mime"], "data": b["data"]}} for b in blocks]
    return {"model": model, "max_tokens": limit, "system": system, "messages": [{"role": "user", "content": content}]}


def system_message_request(model: str, system: str, blocks: list[dict]) -> dict:
    """A request with the system prompt as its first message."""
    content = [b if b["type"] == "text" else {"type": "image_url", "image_url": {"url": f"data:{b['mime']};base64,{b['data']}"}} for b in blocks]
    return {"model": model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": content}]}


def usage_of(response: dict, prompt_key: str, answer_key: str) -> tuple[int, int]:
    """Tokens that a response reports, 0 where it doesn't."""
    usage = response.get("usage") or {}
    return int(usage.get(prompt_key) or 0), int(usage.get(answer_key) or 0)


def crop_png(content: bytes, x: int, y: int, w: int, h: int, padding: int = PADDING) -> bytes:
    image = decode_png(content)
    tall, wide = image.shape[:2]
    x0, y0 = max(0, x - padding), max(0, y - padding)
    return encode_png(image[y0 : y0 + min(tall - y0, h + 2 * padding), x0 : x0 + min(wide - x0, w + 2 * padding)])


def hint(use: Column, fields: Column, node_id: Column) -> Column:
    """What the DOM says of a region, null without a field or where hints are off."""
    return F.when(use & (F.size(F.coalesce(fields, F.array())) > 0), F.struct(fields.alias("fields"), node_id.alias("id")))


def with_crops(regions: DataFrame, images: DataFrame) -> DataFrame:
    """Regions with PNG crops of both images."""

    def run(frames):
        for frame in frames:
            for c in ("before", "after"):
                frame[f"{c}_crop"] = [crop_png(content, *(int(np.floor(v + 0.5)) for v in rect)) for content, *rect in zip(frame[c], *(frame[k] for k in "xywh"), strict=True)]
            yield frame.drop(columns=["before", "after"])

    joined = regions.join(images.select("pair_id", "before", "after"), "pair_id")
    kept = [f for f in joined.schema if f.name not in ("before", "after")]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kept), "before_crop binary, after_crop binary"])
    return joined.mapInPandas(run, schema)


def ask(rows: DataFrame, provider: Callable[[], Provider], system: str = "prompt", images: tuple[str, ...] = ("before_crop", "after_crop"), captions: tuple[str, ...] = ("Before:", "After:")) -> DataFrame:
    """Rows with reply, input_tokens, output_tokens; each partition makes one provider and calls it row by row."""

    def run(frames):
        model = provider()
        for frame in frames:
            answers = []
            for row in frame.to_dict("records"):
                blocks = [b for caption, c in zip(captions, images, strict=True) for b in (text_block(caption), image_block(bytes(row[c])))]
                answers.append(model.send(row[system], blocks))
            frame[["reply", "input_tokens", "output_tokens"]] = pd.DataFrame(answers, index=frame.index, columns=["reply", "input_tokens", "output_tokens"])
            yield frame

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema), "reply string, input_tokens bigint, output_tokens bigint"])
    return rows.mapInPandas(run, schema)


def scripted(rows: DataFrame, responses: DataFrame) -> DataFrame:
    """Rows (key) with replies of a table (key, text): a model whose answers are known, at 10 and 5 tokens a call."""
    out = rows.join(responses.select("key", F.col("text").alias("reply")), "key", "left")
    return out.withColumn("input_tokens", F.lit(10).cast("bigint")).withColumn("output_tokens", F.lit(5).cast("bigint"))


def classified(rows: DataFrame, reply: str = "reply") -> DataFrame:
    """Rows with change_type, description and confidence of their reply."""
    p = rows.withColumn("__p", replies.parsed(F.col(reply)))
    return p.select(*rows.columns, *replies.classification(F.col(reply), F.col("__p")))


def primary(classified_regions: DataFrame) -> DataFrame:
    """pair_id, change_type, description of each pair's largest classified region."""
    return classified_regions.groupBy("pair_id").agg(F.min_by(F.struct("change_type", "description"), "rank").alias("p")).select("pair_id", "p.*")


def classify_regions(
    regions: DataFrame,
    images: DataFrame,
    entries: DataFrame,
    provider: Callable[[], Provider],
    now: Column,
    k: int = TOP_REGIONS,
    use_hint: bool = True,
    ttl_ms: int = cache.TTL_MS,
) -> tuple[DataFrame, DataFrame]:
    """The k largest regions of each pair with change_type, description, confidence, tokens and cached; and the entries to append.

    A region's key is the hash of its crops and of its hint, so equal crops share one call and one entry.  Crops are cut
    and written once, and so are the answers: a model is asked once for a key, whatever is read of them later.
    """
    found = hint(F.lit(use_hint), F.col("changed_fields"), F.col("dom_id"))
    crops = with_crops(top_regions(regions, k), images).withColumn("hint", found)
    keyed = written(crops.withColumn("key", cache.content_key(F.col("before_crop"), F.col("after_crop"), F.to_json("hint"))), "crops")

    def call(keys: DataFrame) -> DataFrame:
        rows = keyed.join(keys, "key", "left_semi").select("key", "before_crop", "after_crop", text.prompt(F.col("hint.fields"), F.col("hint.id")).alias("prompt")).dropDuplicates(["key"])
        answered = classified(ask(rows, provider))
        return written(answered.select("key", F.struct("change_type", "description", "confidence").alias("classification"), "input_tokens", "output_tokens"), "answers")

    answered, fresh = cache.read_through(keyed.drop("before_crop", "after_crop", "hint"), entries, now, call, ttl_ms)
    return answered.select("*", "classification.*").drop("classification"), fresh


#: What a whole pair is asked.
PAIR_PROMPT = "Say whether two screenshots of a page differ, as JSON with changed, changeType, description and region."


def raw_arm(images: DataFrame, answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One row per pair: what a model says of both whole images (pair_id, before, after), with no detection before it.

    ``answer`` adds reply, input_tokens and output_tokens.  A reply that isn't strict JSON counts as no change.
    """
    rows = answer(images.withColumn("prompt", F.lit(PAIR_PROMPT)))
    verdict = rows.withColumn("__p", replies.parsed(F.col("reply"))).select("pair_id", "input_tokens", "output_tokens", *replies.raw_verdict(F.col("__p")))
    regions = F.when(F.col("region").isNotNull(), F.array("region")).otherwise(F.array().cast("array<struct<x:double,y:double,w:double,h:double>>"))
    return verdict.select("pair_id", "changed", regions.alias("regions"), "change_type", "description", "input_tokens", "output_tokens")


def pipeline_arm(pairs: DataFrame, regions: DataFrame, classify: Callable[[DataFrame], DataFrame], k: int = TOP_REGIONS) -> DataFrame:
    """One row per pair: changed, all its regions, the primary region's type and description, tokens, cached.

    ``classify`` answers the top k regions (adds change_type, description, input_tokens, output_tokens, cached).
    A pair without regions is unchanged, with no tokens and a null cached; k may be 0.
    """
    answered = classify(top_regions(regions, k))
    lists = regions.groupBy("pair_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "x", "y", "w", "h"))), lambda r: F.struct(*(r[c].cast("double").alias(c) for c in "xywh"))).alias("regions"))
    out = pairs.select("pair_id").join(lists, "pair_id", "left").join(primary(answered), "pair_id", "left").join(pair_usage(answered), "pair_id", "left")
    tokens = [F.coalesce(c, F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens")]
    return out.select("pair_id", F.col("regions").isNotNull().alias("changed"), F.coalesce("regions", F.array()).alias("regions"), "change_type", "description", *tokens, "cached")


def pixel_arm(pairs: DataFrame, pixels: DataFrame) -> DataFrame:
    """changed wherever there is a pixel region; no type, no tokens."""
    counts = pixels.groupBy("pair_id").agg(F.count("*").alias("n"))
    out = pairs.select("pair_id").join(counts, "pair_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select("pair_id", (F.col("n") > 0).alias("changed"), F.col("n").alias("n_regions"), F.lit(0).cast("bigint").alias("tokens"))


def judged(rows: DataFrame, call: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows (description) with score and rationale; a missing or empty description scores 1 and is never sent."""
    empty = F.coalesce("description", F.lit("")) == ""
    answered = call(rows.where(~empty))
    p = answered.withColumn("__p", replies.parsed(F.col("reply")))
    scored = p.select(*rows.columns, *replies.judgement(F.col("reply"), F.col("__p")))
    return scored.unionByName(rows.where(empty).withColumn("score", F.lit(1)).withColumn("rationale", F.lit("no description")))
