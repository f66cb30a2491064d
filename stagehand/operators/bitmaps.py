"""Facets as bitmaps: for each value of a facet, which shows have it, in buckets of 32,768 places.

A reader's choice is an AND over facets of an OR over the values chosen in each; counts of all other values under that choice are ANDs of
bitmaps, so a page's facets need the index alone and not the shows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INDEX = "facet string, value string, bucket bigint, bits binary"


def index(events: DataFrame, place: str, facets: dict[str, Column]) -> DataFrame:
    """``INDEX`` of shows with distinct places from 0 (``numbering.numbered`` gives them). A facet is a Column of one value or an array of them; null has none."""
    def of(name: str, values: Column) -> Column:
        return F.transform(F.array_compact(values if _many(events, values) else F.array(values)), lambda v: F.struct(F.lit(name).alias("facet"), v.cast("string").alias("value")))

    held = [F.coalesce(of(name, values), F.array().cast("array<struct<facet:string,value:string>>")) for name, values in facets.items()]
    rows = events.select((F.col(place) + 1).alias("_p"), F.explode(F.concat(*held)).alias("f")).select("f.*", F.bitmap_bucket_number("_p").alias("bucket"), F.bitmap_bit_position("_p").alias("bit"))
    return rows.groupBy("facet", "value", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def _many(events: DataFrame, column: Column) -> bool:
    return events.select(column).schema[0].dataType.typeName() == "array"


def chosen(facets: DataFrame, choice: dict[str, list[str]]) -> DataFrame:
    """(``bucket``, ``bits``) of the shows that have one of the values in every facet of a choice."""
    named = reduce(Column.__or__, [(F.col("facet") == f) & F.col("value").isin(*v) for f, v in choice.items()], F.lit(False))
    one = facets.filter(named).groupBy("bucket", "facet").agg(F.bitmap_or_agg("bits").alias("bits"))
    both = one.groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("n"))
    return both.filter(F.col("n") == len(choice)).select("bucket", "bits")


def counts(facets: DataFrame, choice: dict[str, list[str]] | None = None) -> DataFrame:
    """(``facet``, ``value``, ``n``) of shows that have a value and fit the choice; values without such a show have 0."""
    if not choice:
        return facets.groupBy("facet", "value").agg(F.sum(F.bitmap_count("bits")).alias("n"))
    fit = chosen(facets, choice).withColumnRenamed("bits", "fit")
    pairs = facets.join(fit, "bucket", "left").select("facet", "value", "bucket", F.explode(F.when(F.col("fit").isNotNull(), F.array("bits", "fit")).otherwise(F.array(F.lit(b"")))).alias("bits"))
    both = pairs.groupBy("facet", "value", "bucket").agg(F.bitmap_and_agg(F.when(F.length("bits") > 0, F.col("bits"))).alias("both"), F.max(F.length("bits")).alias("any"))
    return both.groupBy("facet", "value").agg(F.sum(F.when(F.col("any") > 0, F.bitmap_count("both")).otherwise(0)).alias("n"))


def crossed(facets: DataFrame, first: str, second: str) -> DataFrame:
    """(``first``, ``second``, ``n``) of every pair of values of two facets that a show has; work goes with the pairs in each bucket."""
    a = facets.filter(F.col("facet") == first).select("bucket", F.col("value").alias("a"), F.col("bits").alias("x"))
    b = facets.filter(F.col("facet") == second).select("bucket", F.col("value").alias("b"), F.col("bits").alias("y"))
    both = a.join(b, "bucket").select("bucket", "a", "b", F.explode(F.array("x", "y")).alias("bits")).groupBy("bucket", "a", "b").agg(F.bitmap_count(F.bitmap_and_agg("bits")).alias("n"))
    return both.groupBy("a", "b").agg(F.sum("n").alias("n")).filter("n > 0").select(F.col("a").alias(first), F.col("b").alias(second), "n")
