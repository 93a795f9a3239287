"""The result cache as a table on shared storage: appended in batches, merged in place, read by parts.

    log/batch=<name>/prefix=<p>/    entries of one append
    base/gen=<n>/prefix=<p>/        the newest entry of each key, as a compaction left it
    state/<n>                       which generation holds each prefix, and which batches it has

A prefix is the beginning of a hash of the key, so a lookup reads the folders of its keys' prefixes only, and a
compaction writes those that have something new.  A state is written once and never changed: the highest number counts.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .cache import TTL_MS, latest, probe


def prefix_of(key: Column, digits: int) -> Column:
    return F.substring(F.sha2(F.coalesce(key, F.lit("")), 256), 1, digits)


@dataclass
class _State:
    """Number, generation of each prefix, and names of the batches that these hold."""

    number: int = 0
    gens: dict[str, int] = field(default_factory=dict)
    batches: list[str] = field(default_factory=list)


class CacheTable:
    """Entries (key, classification, cached_at) under ``path``; keys are spread over 16 ** ``digits`` prefixes."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, digits: int = 2):
        self.spark, self.path, self.schema, self.digits = spark, path.rstrip("/"), schema, digits

    def _files(self, where: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{where}")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _names(self, where: str) -> list[str]:
        fs, place = self._files(where)
        return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []

    def _state(self) -> _State:
        numbers = [int(n) for n in self._names("state") if n.isdigit()]
        if not numbers:
            return _State()
        fs, place = self._files(f"state/{max(numbers)}")
        stream = fs.open(place)
        try:
            kept = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return _State(max(numbers), kept["gens"], kept["batches"])

    def _commit(self, state: _State) -> None:
        """Fails where another compaction has written the same number."""
        fs, place = self._files(f"state/{state.number}")
        stream = fs.create(place, False)
        try:
            stream.write(bytearray(json.dumps({"gens": state.gens, "batches": state.batches}).encode()))
        finally:
            stream.close()

    def _pending(self, state: _State) -> list[str]:
        """Batches that are whole and that no compaction has taken in."""
        names = [n.removeprefix("batch=") for n in self._names("log")]
        return [n for n in names if n not in state.batches and "_SUCCESS" in self._names(f"log/batch={n}")]

    def append(self, entries: DataFrame, batch: str) -> None:
        """Add entries as the batch of this name (letters, digits, - and _): appended again, after a failure say, it counts once."""
        if not re.fullmatch(r"[\w-]+", batch):
            raise ValueError(f"not a batch name: {batch!r}")
        if batch in self._state().batches:
            return
        rows = entries.select(*self.schema.names).withColumn("prefix", prefix_of(F.col("key"), self.digits))
        rows.repartition("prefix").write.mode("overwrite").partitionBy("prefix").parquet(f"{self.path}/log/batch={batch}")

    def _read(self, folders: list[str]) -> DataFrame:
        """The entries of folders of prefixes."""
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(*(f"{self.path}/{f}" for f in folders))

    def _folders(self, state: _State, wanted: set[str] | None) -> list[str]:
        base = [f"base/gen={g}/prefix={p}" for p, g in sorted(state.gens.items()) if wanted is None or p in wanted]
        log = [f"log/batch={b}/{n}" for b in self._pending(state) for n in self._names(f"log/batch={b}") if n.startswith("prefix=") and (wanted is None or n.removeprefix("prefix=") in wanted)]
        return base + log

    def entries(self, keys: DataFrame | None = None) -> DataFrame:
        """The newest entry of each key; with ``keys`` (key), of the prefixes that these have."""
        wanted = None
        if keys is not None:
            wanted = {r[0] for r in keys.select(prefix_of(F.col("key"), self.digits)).distinct().collect()}  # 16 ** digits at most
        return latest(self._read(self._folders(self._state(), wanted)))

    def lookup(self, requests: DataFrame, now: Column, ttl_ms: int = TTL_MS) -> DataFrame:
        """``probe`` of requests (key, ...) against the table."""
        return probe(requests, self.entries(requests.select("key")), now, ttl_ms)

    def compact(self) -> None:
        """Merge the batches into new generations of the prefixes that they touch; what is read stays the same."""
        state = self._state()
        pending = self._pending(state)
        if not pending:
            return
        touched = {n.removeprefix("prefix=") for b in pending for n in self._names(f"log/batch={b}") if n.startswith("prefix=")}
        number = state.number + 1
        if touched:
            merged = latest(self._read(self._folders(state, touched))).withColumn("prefix", prefix_of(F.col("key"), self.digits))
            merged.repartition("prefix").write.mode("overwrite").partitionBy("prefix").parquet(f"{self.path}/base/gen={number}")
        self._commit(_State(number, state.gens | dict.fromkeys(sorted(touched), number), [*state.batches, *pending]))

    def vacuum(self) -> None:
        """Delete what the last state doesn't need; readers of an earlier state must have ended."""
        state = self._state()
        live = {f"gen={g}/prefix={p}" for p, g in state.gens.items()}
        dead = [f"base/{g}/{p}" for g in self._names("base") for p in self._names(f"base/{g}") if p.startswith("prefix=") and f"{g}/{p}" not in live]
        dead += [f"log/batch={b}" for b in state.batches if f"batch={b}" in self._names("log")]
        dead += [f"state/{n}" for n in self._names("state") if n.isdigit() and int(n) < state.number]
        for where in dead:
            fs, place = self._files(where)
            fs.delete(place, True)
