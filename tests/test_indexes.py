import itertools
import random

import pytest
from pyspark.sql import functions as F

from stagehand.functions.text import slug_match
from stagehand.operators import bitmaps, grams, sketches
from stagehand.operators.numbering import numbered


def test_gram_join_equals_the_nested_loop(spark):
    rng = random.Random(3)
    slugs = ["".join(rng.choice("ab") for _ in range(rng.randrange(4, 14))) for _ in range(150)] + ["", None, "abcdef", "xabcdefx", "abcdefgh", "abcdefghi", "short"]
    a = spark.createDataFrame(list(enumerate(slugs)), "i int, s string")
    b = spark.createDataFrame([(i, s) for i, s in enumerate(reversed(slugs))], "j int, t string")
    found = grams.matches(a, b, "i", "j", "s", "t")
    want = {tuple(r) for r in a.join(b, slug_match(F.col("s"), F.col("t"))).select("i", "j").collect()}
    got = [tuple(r) for r in found.collect()]
    assert set(got) == want and len(got) == len(want) > 100
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def rows(spark, data):
    return spark.createDataFrame(data, "g string, k long")


def test_changes_from_sketches(spark):
    old, new = [("a", i) for i in range(1000)] + [("b", 1), (None, 5)], [("a", i) for i in range(400, 1700)] + [("c", 1), ("c", None), ("c", None), (None, 6)]
    got = {r["g"]: tuple(r)[1:] for r in sketches.changes(*(sketches.kept(rows(spark, d), ["g"], ["k"]) for d in (old, new)), ["g"]).collect()}
    assert got == {"a": (1000, 1300, 700, 400), "b": (1, 0, 0, 1), "c": (0, 2, 2, 0), None: (1, 1, 1, 1)}


def test_bound_of_large_sketches_over_snapshots(spark):
    day = lambda n: spark.range(n * 50_000, n * 50_000 + 100_000).select(F.lit("x").alias("g"), F.col("id").alias("k"))
    kept = [sketches.kept(day(n), ["g"], ["k"]) for n in range(4)]
    union = kept[0].unionByName(kept[1]).unionByName(kept[2]).unionByName(kept[3])
    assert sketches.distinct(union, ["g"]).first()["keys"] == pytest.approx(250_000, rel=4 / 64)
    change = sketches.changes(kept[0], kept[1], ["g"]).first()
    for name in ("added", "gone"):
        assert abs(change[name] - 50_000) < 4 / 64 * 150_000
    assert sketches.distinct(union.limit(0), ["g"]).collect() == []


def shows(n=3000):
    rng = random.Random(8)
    return [(i, rng.choice("pqr"), [t for t in "abcd" if rng.random() < 0.3] or None) for i in range(n)]


def test_facet_counts_are_ands_of_bitmaps(spark):
    data = shows() + [(40_000, "p", ["a", "a"]), (70_000, None, [None, "b"])]
    events = spark.createDataFrame(data, "n long, venue string, tags array<string>")
    index = bitmaps.index(events, "n", {"venue": F.col("venue"), "tag": F.col("tags")}).cache()
    of = lambda r: {("venue", r[1])} - {("venue", None)} | {("tag", t) for t in r[2] or () if t}
    values = {v for r in data for v in of(r)}
    for choice in ({}, {"tag": ["a"]}, {"tag": ["a", "c"], "venue": ["p"]}, {"venue": ["nowhere"]}):
        fits = [r for r in data if all(any((f, v) in of(r) for v in vs) for f, vs in choice.items())]
        got = {(r["facet"], r["value"]): r["n"] for r in bitmaps.counts(index, choice).collect()}
        assert got == {v: sum(v in of(r) for r in fits) for v in values}, choice
    pairs = {(r["tag"], r["venue"]): r["n"] for r in bitmaps.crossed(index, "tag", "venue").collect()}
    want = {(t, v): sum(("tag", t) in of(r) and ("venue", v) in of(r) for r in data) for t, v in itertools.product("abcd", "pqr")}
    assert pairs == {k: n for k, n in want.items() if n}


def test_places_by_numbering(spark):
    events = numbered(spark.createDataFrame([("x", ["a"]), ("y", None)], "k string, tags array<string>"), "k", name="n")
    assert [(r["value"], r["n"]) for r in bitmaps.counts(bitmaps.index(events, "n", {"tag": F.col("tags")})).collect()] == [("a", 1)]
    empty = bitmaps.index(events.limit(0), "n", {"tag": F.col("tags")})
    assert bitmaps.counts(empty).collect() == [] == bitmaps.counts(empty, {"tag": ["a"]}).collect()


def test_changes_counted_exactly_past_a_sketch(spark):
    old, new = (spark.range(a, b).select((F.col("id") % 2).alias("g"), F.col("id").alias("k")) for a, b in ((0, 30_000), (10_001, 50_000)))
    twice = old.unionByName(old)
    got = {tuple(r) for r in sketches.counted(twice, new, ["g"], ["k"]).collect()}
    assert got == {(0, 15_000, 19_999, 10_000, 5_001), (1, 15_000, 20_000, 10_000, 5_000)}
