"""Which slugs hold the start of which others: a theta join as an equi-join on grams.

A slug matches another if either holds the first eight characters of the other (all of it, if it has six or seven). So every slug is indexed by
its distinct grams of six to eight characters and asked for by its start alone; what shares a gram is a match by construction, and ``verify``
checks it again. Work goes with the characters of the slugs and the matches found, not with the pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagehand.functions.text import slug_match

LEAST, START = 6, 8


def grams(slug: Column) -> Column:
    """The distinct grams of ``LEAST`` to ``START`` characters."""
    def of(n: int) -> Column:
        starts = F.when(F.length(slug) >= n, F.sequence(F.lit(1), F.length(slug) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(slug, i, F.lit(n)))

    return F.array_distinct(F.concat(*[of(n) for n in range(LEAST, START + 1)]))


def matches(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_slug: str, right_slug: str) -> DataFrame:
    """Distinct (``left_id``, ``right_id``) of slugs that match; shorter ones than ``LEAST`` and nulls match nothing."""
    a, b = left.select(F.col(left_id).alias("a"), F.col(left_slug).alias("sa")), right.select(F.col(right_id).alias("b"), F.col(right_slug).alias("sb"))

    def held(inside: DataFrame, s: str, asked: DataFrame, t: str) -> DataFrame:
        index = inside.select("*", F.explode(grams(F.col(s))).alias("gram"))
        starts = asked.filter(F.length(t) >= LEAST).withColumn("gram", F.substring(t, 1, START))
        return index.join(starts, "gram").select("a", "b", "sa", "sb")

    found = held(a, "sa", b, "sb").unionByName(held(b, "sb", a, "sa")).distinct()
    return found.filter(slug_match(F.col("sa"), F.col("sb"))).select(F.col("a").alias(left_id), F.col("b").alias(right_id))
