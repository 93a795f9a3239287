"""The result cache over a stream of requests: keyed state with a time to live, told by event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.cache import TTL_MS

HITS = "id bigint, key string, hit boolean"
#: When the keys of a bucket were last asked of the model.
STATE = "keys array<string>, asked array<bigint>"
#: Buckets of keys: a call and a state each, as one for every key costs far more than the work on its requests.
BUCKETS = 4096


def _answered(ttl_ms: int):
    """What a bucket's requests hit.  A key goes once the watermark says that every later request would be a miss anyway."""

    def run(bucket: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip(*state.get, strict=True)) if state.exists else {}
        if not state.hasTimedOut:
            rows = pd.concat(list(frames)).sort_values(["at_ms", "id"], kind="stable")
            keys, hits = [None if pd.isna(k) else k for k in rows["key"].tolist()], []
            for key, at in zip(keys, rows["at_ms"].tolist(), strict=True):
                asked = held.get(key)
                hits.append(asked is not None and at - asked <= ttl_ms)
                if not hits[-1]:
                    held[key] = at
            yield pd.DataFrame({"id": rows["id"].to_numpy(), "key": pd.Series(keys, dtype=object), "hit": hits})
        seen = state.getCurrentWatermarkMs()
        held = {k: at for k, at in held.items() if at + ttl_ms >= seen}
        if held:
            state.update((list(held), list(held.values())))
            state.setTimeoutTimestamp(max(min(held.values()) + ttl_ms, seen) + 1)
        elif state.exists:
            state.remove()

    return run


def replay(log: DataFrame, ttl_ms: int = TTL_MS, late: str = "1 hour") -> DataFrame:
    """HITS of streamed requests (key, at, id): what ``operators.cache.replay`` says of the same requests in one table.

    Requests may come out of order within a micro-batch, whose rows of one bucket of keys are held by a task; requests of a
    later batch are taken as later ones.  Those more than ``late`` behind the latest seen (and those of 1970 or before) are dropped by the
    watermark, which bounds the state: a key is forgotten ``ttl_ms`` after its entry.  A null key is a key; rows without a time have no place and no result.
    """
    rows = log.where("at is not null").select(F.col("id").cast("bigint").alias("id"), F.col("key").cast("string").alias("key"), F.col("at").cast("timestamp").alias("at"))
    timed = rows.withWatermark("at", late).withColumn("at_ms", F.unix_millis("at")).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)))
    return timed.groupBy("bucket").applyInPandasWithState(_answered(ttl_ms), HITS, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def replayed(log: DataFrame, folder: str, ttl_ms: int = TTL_MS, late: str = "1 hour") -> None:
    """Run the stream over all that there is, and append HITS to ``folder``/hits; its progress is kept beside them, so a second run goes on."""
    sink = replay(log, ttl_ms, late).writeStream.format("parquet").option("path", f"{folder}/hits").option("checkpointLocation", f"{folder}/progress")
    sink.trigger(availableNow=True).start().awaitTermination()
