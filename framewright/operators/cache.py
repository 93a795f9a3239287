"""The result cache: content keys, lookups with a time to live, and replay of a request log."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TTL_MS = 7 * 24 * 3600 * 1000


def content_key(before: Column, after: Column, context: Column | None = None) -> Column:
    """SHA-256 of both crops and, where it says something, the context."""
    parts = [before.cast("binary"), after.cast("binary")]
    if context is not None:
        parts.append(F.coalesce(context, F.lit("")).cast("binary"))
    return F.sha2(F.concat(*parts), 256)


def age_ms(now: Column, then: Column) -> Column:
    return F.unix_millis(now.cast("timestamp")) - F.unix_millis(then.cast("timestamp"))


def latest(entries: DataFrame) -> DataFrame:
    """What an appended table holds now: the newest entry of each key, of equally old ones the greatest classification."""
    rest = [c for c in entries.columns if c != "key"]
    at = F.coalesce(F.col("cached_at").cast("timestamp"), F.lit("0001-01-01").cast("timestamp"))
    return entries.groupBy("key").agg(F.max(F.struct(at.alias("at"), F.struct(*rest).alias("e"))).alias("m")).select("key", "m.e.*")


def append(entries: DataFrame, path: str) -> None:
    """Add entries (key, classification, cached_at) to the store at ``path``; an older entry of a key stays, and ``latest`` passes it over."""
    entries.write.mode("append").parquet(path)


def entries_at(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The entries of the store at ``path``, none where nothing was appended yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


class MemoryStore:
    """Entries as a DataFrame of this session, for tests and single runs; nothing in it grows old."""

    def __init__(self, entries: DataFrame):
        self.entries = entries

    def append(self, entries: DataFrame) -> None:
        self.entries = self.entries.unionByName(entries)

    def answers(self) -> DataFrame:
        return latest(self.entries).withColumn("cached_at", F.lit(None).cast("timestamp"))


def probe(requests: DataFrame, entries: DataFrame, now: Column, ttl_ms: int = TTL_MS) -> DataFrame:
    """Requests with the classification of their entry and hit; an entry older than the time to live is a miss, one without a date a hit."""
    found = requests.join(entries.select("key", "classification", "cached_at", F.lit(True).alias("found")), "key", "left")
    fresh = ~F.coalesce(age_ms(now, F.col("cached_at")) > ttl_ms, F.lit(False))
    hit = F.coalesce(F.col("found"), F.lit(False)) & fresh
    return found.withColumn("hit", hit).withColumn("classification", F.when(hit, F.col("classification"))).drop("found", "cached_at")


def read_through(requests: DataFrame, entries: DataFrame, now: Column, call: Callable[[DataFrame], DataFrame], ttl_ms: int = TTL_MS) -> tuple[DataFrame, DataFrame]:
    """Answered requests, and the entries to append.

    ``call`` answers distinct missing keys (key -> key, classification, input_tokens, output_tokens).  Hits cost
    no tokens and don't renew their entry; every request that missed bears its call's tokens, as none waits for another.
    """
    probed = probe(requests, latest(entries), now, ttl_ms)
    answers = call(probed.where("not hit").select("key").distinct())
    hits = probed.where("hit").withColumn("input_tokens", F.lit(0).cast("bigint")).withColumn("output_tokens", F.lit(0).cast("bigint"))
    misses = probed.where("not hit").drop("classification").join(answers, "key")
    out = hits.unionByName(misses).withColumnRenamed("hit", "cached")
    return out, answers.select("key", "classification", now.alias("cached_at"))


def replay(log: DataFrame, ttl_ms: int = TTL_MS) -> DataFrame:
    """Requests (key, at, id) with hit, as if made one after another: a miss sets a key's time anew, a hit doesn't.

    Keys are sorted on disk and walked in a stream, so a key of any number of requests takes constant memory.
    """

    def run(frames):
        key, anchor = None, None
        for frame in frames:
            hits = []
            for k, at in zip(frame["key"], frame["at_ms"], strict=True):
                hit = k == key and at - anchor <= ttl_ms
                if not hit:
                    key, anchor = k, at
                hits.append(hit)
            yield pd.DataFrame({"id": frame["id"], "key": frame["key"], "hit": hits})

    rows = log.select(F.col("id").cast("bigint").alias("id"), F.col("key").cast("string").alias("key"), F.unix_millis(F.col("at").cast("timestamp")).alias("at_ms"))
    return rows.repartition("key").sortWithinPartitions("key", "at_ms", "id").mapInPandas(run, "id bigint, key string, hit boolean")
