"""Quantiles without keeping a group's values.

``exact`` narrows every wanted rank to a bin of a histogram of its group, then to a bin of that bin, until a bin holds one value: a round counts
(group, bin), summed before the shuffle, so a group may hold any share of the rows and each round shuffles ``bins`` rows for each group and task at most.
The state, a row for each group and rank, is a written table. ``sketch`` keeps a KLL sketch for each group, which merges with those of other
snapshots; its ranks are off by 1.65 % at ``k`` 200, Spark's default.

Nulls and NaN take no part; a group without a value has null quantiles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagehand.session import written


def _same(left: DataFrame, right: DataFrame, by: list[str]) -> Column:
    """Equal groups, null ones too."""
    return reduce(Column.__and__, [left[b].eqNullSafe(right[f"_g_{b}"]) for b in by], F.lit(True))


def _prefixed(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.withColumnsRenamed({b: f"_g_{b}" for b in by})


def exact(rows: DataFrame, by: list[str], value: str, shares: tuple[float, ...] = (0.5,), bins: int = 1024) -> DataFrame:
    """(``by``, ``share``, ``quantile``): for each group and share the value at that share of its order, between two values in proportion, as ``percentile`` has it."""
    spark = rows.sparkSession
    v = F.col(value).cast("double")
    told = rows.select(*by, v.alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    at = (F.col("n") - 1) * F.col("share")
    wanted = told.groupBy(*by).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")).withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    ranks = wanted.withColumn("rank", F.explode(F.array_distinct(F.array(F.floor(at), F.ceil(at))))).withColumn("below", F.lit(0).cast("long"))
    done = ranks.filter("lo = hi").limit(0)
    todo = written(ranks, "ranks")
    while True:
        done = done.unionByName(todo.filter("lo = hi"))
        todo = todo.filter("lo < hi")
        if todo.isEmpty():
            break
        todo = written(_narrowed(told, todo, by, bins), "ranks")
    low, high = F.min_by("lo", "rank"), F.max_by("lo", "rank")
    part = F.first((F.col("n") - 1) * F.col("share") - F.floor((F.col("n") - 1) * F.col("share")))
    found = done.groupBy(*by, "share").agg((low + (high - low) * part).alias("quantile"))
    groups = rows.select(*by).distinct() if by else spark.range(1).select()
    every = groups.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    right = _prefixed(found, by).withColumnRenamed("share", "_share")
    return every.join(right, _same(every, right, by) & (every["share"] == right["_share"]), "left").select(*by, "share", "quantile")


def _narrowed(told: DataFrame, todo: DataFrame, by: list[str], bins: int) -> DataFrame:
    """The ranks with the least and greatest value of the bin that each falls in, and the number of values below it."""
    right = _prefixed(todo, by)
    inside = told.join(right, _same(told, right, by) & told["_v"].between(right["lo"], right["hi"]))
    place = (F.col("_v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)  # halves, as the span may be beyond a double
    keys = [*by, "n", "share", "rank", "below"]
    counted = inside.groupBy(*keys, F.least(F.floor(place * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("c"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    upto = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = counted.withColumn("upto", F.col("below") + F.sum("c").over(upto))
    hit = running.filter((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("c")))
    return hit.withColumn("below", F.col("upto") - F.col("c")).select(*by, "n", "lo", "hi", "share", "rank", "below")


def sketch(rows: DataFrame, by: list[str], value: str, k: int = 200) -> DataFrame:
    """(``by``, ``sketch``): a KLL sketch of each group's values, to be kept beside a snapshot."""
    v = F.col(value).cast("double")
    return rows.filter(v.isNotNull() & ~F.isnan(v)).groupBy(*by).agg(F.kll_sketch_agg_double(v, k).alias("sketch"))


def merged(sketches: DataFrame, by: list[str], shares: tuple[float, ...] = (0.5,)) -> DataFrame:
    """(``by``, ``n``, ``share``, ``quantile``) of the sketches of one or many snapshots, without their rows."""
    one = sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("s"))
    return one.select(*by, F.kll_sketch_get_n_double("s").alias("n"), F.explode(F.array(*[F.struct(F.lit(float(x)).alias("share"), F.kll_sketch_get_quantile_double("s", F.lit(float(x))).alias("quantile")) for x in shares])).alias("q")).select(*by, "n", "q.*")
