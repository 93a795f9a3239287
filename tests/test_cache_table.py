"""The cache as a table that is appended, merged and pruned; and as state of a stream."""

import pytest
from pyspark.sql import functions as F

from framewright.operators import cache
from framewright.operators.cache_table import CacheTable
from framewright.streaming import replay

ENTRY = "key string, classification string, cached_at timestamp"


@pytest.fixture
def table(spark, tmp_path):
    return CacheTable(spark, str(tmp_path / "cache"), spark.createDataFrame([], ENTRY).schema, digits=1)


def rows(spark, *entries):
    return spark.createDataFrame([(k, c, d) for k, c, d in entries], "key string, classification string, cached_at string").withColumn("cached_at", F.col("cached_at").cast("timestamp"))


def held(df):
    return sorted((r.key or "-", r.classification) for r in df.collect())


def test_batches_are_merged(spark, table):
    assert held(table.entries()) == []
    table.compact()
    first = rows(spark, ("a", "old", "2024-01-01"), ("b", "b1", "2024-01-02"), (None, "null", None))
    table.append(first, "one")
    table.append(first, "one")
    table.append(rows(spark, ("a", "new", "2024-01-05"), ("c", "c1", "2024-01-03")), "two")
    want = [("-", "null"), ("a", "new"), ("b", "b1"), ("c", "c1")]
    assert held(table.entries()) == want and table._read(table._folders(table._state(), None)).count() == 5
    table.compact()
    assert held(table.entries()) == want and table._read(table._folders(table._state(), None)).count() == 4
    table.append(first, "one")  # a batch that is merged stays merged
    table.append(rows(spark, ("a", "older", "2024-01-03"), ("b", "b2", "2024-01-09")), "three")
    table.append(rows(spark).limit(0), "empty")
    table.compact()
    table.compact()
    table.vacuum()
    assert held(table.entries()) == [("-", "null"), ("a", "new"), ("b", "b2"), ("c", "c1")]
    assert table._names("log") == [] and table._names("state") == ["2"]
    with pytest.raises(ValueError):
        table.append(first, "../one")


def test_an_unfinished_batch_is_not_read(spark, table):
    table.append(rows(spark, ("a", "x", "2024-01-01")), "done")
    table.append(rows(spark, ("b", "y", "2024-01-01")), "broken")
    fs, place = table._files("log/batch=broken/_SUCCESS")
    fs.delete(place, False)
    assert held(table.entries()) == [("a", "x")]
    table.append(rows(spark, ("b", "z", "2024-01-01")), "broken")
    assert held(table.entries()) == [("a", "x"), ("b", "z")]


def test_two_compactions_do_not_overwrite_each_other(spark, table):
    table.append(rows(spark, ("a", "x", "2024-01-01")), "one")
    state = table._state()
    table.compact()
    state.number += 1
    with pytest.raises(Exception, match="exist"):
        table._commit(state)
    assert held(table.entries()) == [("a", "x")]


def test_lookups_read_the_prefixes_of_their_keys(spark, table):
    many = rows(spark, *((f"k{i}", f"c{i}", "2024-01-10") for i in range(200)))
    table.append(many, "one")
    table.compact()
    found = table.lookup(spark.createDataFrame([("k7",), ("k7",), ("none",)], "key string"), F.expr("timestamp '2024-01-12'"))
    assert sorted((r.key, r.hit, r.classification) for r in found.collect()) == [("k7", True, "c7"), ("k7", True, "c7"), ("none", False, None)]
    read = {f.split("prefix=")[1].split("/")[0] for f in table.entries(spark.createDataFrame([("k7",), ("none",)], "key string")).inputFiles()}
    assert 1 <= len(read) <= 2 and len({f.split("prefix=")[1].split("/")[0] for f in table.entries().inputFiles()}) == 16
    late = table.lookup(spark.createDataFrame([("k7",)], "key string"), F.expr("timestamp '2024-01-20'")).collect()
    assert [(r.hit, r.classification) for r in late] == [(False, None)]


def test_streamed_requests_hit_as_those_of_a_table(spark, tmp_path):
    """Micro-batches with ties, rows out of order within a batch, a null key, entries that age out, and a restart."""
    day = 24 * 3600
    log = [(i, f"k{i % 3}" if i % 7 else None, 19_700 * day + (i * 11) % 40 * day // 10 + i // 10 * 4 * day) for i in range(60)]
    df = spark.createDataFrame(log, "id long, key string, s long").withColumn("at", F.timestamp_seconds("s")).drop("s")
    ttl = 3 * day * 1000
    for k in range(3):
        df.where(F.col("id").between(k * 20, k * 20 + 19)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        if k:  # the first run sees two files, the second goes on from there
            replay.replayed(stream, str(tmp_path), ttl, "30 days")
    got = {r.id: r.hit for r in spark.read.parquet(str(tmp_path / "hits")).collect()}
    held_at, want = {}, {}
    for k in range(3):
        for i, key, at in sorted((r for r in log if k * 20 <= r[0] < k * 20 + 20), key=lambda r: (r[2], r[0])):
            want[i] = key in held_at and at * 1000 - held_at[key] <= ttl
            if not want[i]:
                held_at[key] = at * 1000
    assert got == want and 0 < sum(want.values()) < 60
    ordered = cache.replay(df.where("key is not null"), ttl)
    assert ordered.count() == sum(r[1] is not None for r in log)
