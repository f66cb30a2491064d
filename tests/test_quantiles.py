import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from stagehand.operators import quantiles


def groups():
    rng = random.Random(9)
    out = [("hot", rng.choice((rng.gauss(0, 1e6), float(rng.randrange(5)), -0.0))) for _ in range(4000)]
    out += [("ties", 3.5)] * 50 + [("two", 1.0), ("two", 2.0), ("one", 7.0), ("none", None), ("none", math.nan), (None, 1.0), (None, 4.0), (None, None)]
    return out + [("wide", x) for x in (-1.7e308, -5.0, 5e-324, 1.7e308)]


@pytest.mark.parametrize("bins", [16, 1024])
def test_exact_quantiles(spark, bins):
    rows = spark.createDataFrame(groups(), "g string, v double").repartition(4)
    shares = (0.0, 0.25, 0.5, 0.9, 1.0)
    got = {(r["g"], r["share"]): r["quantile"] for r in quantiles.exact(rows, ["g"], "v", shares, bins).collect()}
    assert len(got) == 7 * 5
    for g in {g for g, _ in groups()}:
        values = sorted(v for h, v in groups() if h == g and v is not None and not math.isnan(v))
        for s in shares:
            if not values:
                assert got[g, s] is None
                continue
            at = (len(values) - 1) * s
            a, b = values[math.floor(at)], values[math.ceil(at)]
            assert got[g, s] == pytest.approx(a + (b - a) * (at - math.floor(at)), rel=1e-12)
        if values:
            assert got[g, 0.5] == pytest.approx(statistics.median(values), rel=1e-12)


def test_no_group_is_kept(spark):
    rows = spark.createDataFrame(groups(), "g string, v double")
    plan = quantiles.exact(rows, ["g"], "v")._jdf.queryExecution().toString()
    assert "percentile" not in plan.lower() and "median" not in plan.lower() and "collect_list" not in plan.lower()


def test_no_groups_and_no_rows(spark):
    none = spark.createDataFrame([], "g string, v double")
    assert quantiles.exact(none, ["g"], "v").collect() == []
    assert [tuple(r) for r in quantiles.exact(none, [], "v").collect()] == [(0.5, None)]
    assert [tuple(r) for r in quantiles.exact(spark.range(4), [], "id").collect()] == [(0.5, 1.5)]


def test_sketches_of_snapshots_merge(spark):
    rng = random.Random(1)
    days = [[("a", rng.random()) for _ in range(20_000)] for _ in range(3)]
    kept = [quantiles.sketch(spark.createDataFrame(d, "g string, v double"), ["g"], "v") for d in days]
    whole = kept[0].unionByName(kept[1]).unionByName(kept[2])
    for r in quantiles.merged(whole, ["g"], (0.1, 0.5, 0.99)).collect():
        assert r["n"] == 60_000 and abs(r["quantile"] - r["share"]) < 0.03
    assert quantiles.merged(kept[0].filter(F.lit(False)), ["g"]).collect() == []
