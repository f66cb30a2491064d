import os
import random

from pyspark.sql import functions as F

from stagehand.operators import hashtree, snapshots
from stagehand.operators.cachetable import CacheTable

SCHEMA = "fp string, keep boolean, last_seen date"


def exchanges_above_cache(df):
    """Exchanges between a join and the cache's scan, in the plan that runs."""
    df.collect()
    lines = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].split("\n")
    scan = next(i for i, x in enumerate(lines) if "cache_" in x and "Scan" in x)
    depth = lambda x: len(x) - len(x.lstrip(" :+-*()0123456789"))
    at, found = depth(lines[scan]), 0
    for x in reversed(lines[:scan]):
        if depth(x) < at:
            at = depth(x)
            if "Join" in x:
                return found
            found += "Exchange" in x
    return found


def test_cache_is_joined_and_replaced_without_a_shuffle(spark, tmp_path):
    cache = CacheTable(spark, str(tmp_path / "cache"), "fp", SCHEMA, buckets=4)
    rows = spark.createDataFrame([(i, f"k{i % 50}") for i in range(500)] + [(999, None)], "i int, fp string")
    assert cache.pending(rows).count() == 501 and cache.generation() == -1
    cache.put(spark.createDataFrame([(f"k{i}", i % 2 == 0, None) for i in range(30)] + [("k1", True, None)], SCHEMA))
    assert cache.generation() == 0 and cache.entries().count() == 30
    found, left = cache.lookup(rows), cache.pending(rows)
    assert exchanges_above_cache(found) == 0 == exchanges_above_cache(left)
    assert found.filter("keep is not null").count() == 300 and {r["fp"] for r in left.collect()} == {f"k{i}" for i in range(30, 50)} | {None}
    cache.put(spark.createDataFrame([("k3", True, None), ("k77", False, None)], SCHEMA), F.col("fp") != "k4")
    assert cache.generation() == 1 and cache.entries().count() == 30
    kept = {r["fp"]: r["keep"] for r in cache.entries().collect()}
    assert kept["k3"] is True and kept["k77"] is False and "k4" not in kept and kept["k5"] is False
    cache.clean()
    assert os.listdir(tmp_path / "cache") == ["generation=1"] and CacheTable(spark, str(tmp_path / "cache"), "fp", SCHEMA, 4).entries().count() == 30


def test_half_a_generation_is_not_current(spark, tmp_path):
    cache = CacheTable(spark, str(tmp_path / "cache"), "fp", SCHEMA, buckets=2)
    cache.put(spark.createDataFrame([("a", True, None)], SCHEMA))
    (tmp_path / "cache/generation=5").mkdir()
    assert cache.generation() == 0 and cache.entries().count() == 1


def test_hash_tree_reads_what_changed(spark, tmp_path):
    rng = random.Random(5)
    old = [(i, rng.choice("abc"), rng.random()) for i in range(4000)]
    new = [r for r in old if r[0] not in (7, 8)] + [(5000, "a", 1.0)]
    new = [(i, c, v + 1 if i == 100 else v) for i, c, v in new]
    schema = "k int, c string, v double"
    tables = [spark.createDataFrame(r, schema) for r in (old, new, old[::-1])]
    at = [str(tmp_path / n) for n in ("old", "new", "again")]
    for t, p in zip(tables, at):
        hashtree.save(t, ["k"], p, 6, 3)
    got = hashtree.changed(at[0], at[1], ["k"], tables[0], 6, 3)
    want = snapshots.difference(tables[0], tables[1], ["k"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) == [(7, "gone"), (8, "gone"), (5000, "added")]
    leaves = hashtree.differing(spark, at[0], at[1], 6, 3)
    assert 1 <= len(leaves) <= 4 and hashtree.differing(spark, at[0], at[2], 6, 3) == []
    read = hashtree.leaves(spark, at[0], leaves, tables[0].withColumn("leaf", F.lit(0)).schema).inputFiles()
    assert {f.split("leaf=")[1].split("/")[0] for f in read} >= {str(x) for x in leaves}
    files = hashtree.leaves(spark, at[0], leaves, tables[0].withColumn("leaf", F.lit(0)).schema).select(F.input_file_name().alias("f")).distinct().count()
    assert files <= len(leaves)
    plan = hashtree.leaves(spark, at[0], leaves, tables[0].withColumn("leaf", F.lit(0)).schema)._jdf.queryExecution().toString()
    assert "PartitionFilters: [leaf" in plan or "PartitionFilters: [(leaf" in plan


def test_empty_snapshots(spark, tmp_path):
    none = spark.createDataFrame([], "k int")
    some = spark.createDataFrame([(1,), (1,), (None,)], "k int")
    hashtree.save(none, ["k"], str(tmp_path / "a"), 4, 2)
    hashtree.save(some, ["k"], str(tmp_path / "b"), 4, 2)
    assert sorted(map(tuple, hashtree.changed(str(tmp_path / "a"), str(tmp_path / "b"), ["k"], none, 4, 2).collect()), key=repr) == [(1, "added"), (None, "added")]
    assert hashtree.changed(str(tmp_path / "a"), str(tmp_path / "a"), ["k"], none, 4, 2).collect() == []
