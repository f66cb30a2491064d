"""Patching a registry of settings: a venue is a row (``id``, ``fields`` as a map of JSON texts)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Settings that mark a venue that isn't set up yet, so any patch replaces them; and the one that a verified venue loses too.
STALE = ("fetch_method", "one_stage", "url_verified", "strategy", "last_verified")
BLOCKED = "blocked_by"


def merge(registry: DataFrame, patches: DataFrame, as_of: Column) -> DataFrame:
    """``registry`` with ``patched``: a patch owns the settings that it names and the stale ones, all others stay; ``last_verified`` is ``as_of`` if it isn't named."""
    named = patches.select("id", F.col("fields").alias("_p"))
    stamp = F.create_map(F.lit("last_verified"), F.concat(F.lit('"'), as_of.cast("string"), F.lit('"')))
    patch = F.when(F.map_contains_key("_p", "last_verified"), F.col("_p")).otherwise(F.map_concat("_p", stamp))
    verified = F.coalesce(F.element_at("_p", "url_verified") == "true", F.lit(False))
    gone = lambda k: k.isin(*STALE) | (verified & (k == BLOCKED)) | F.map_contains_key(F.col("_p"), k)
    merged = F.map_concat(F.map_filter("fields", lambda k, _: ~gone(k)), patch)
    rows = registry.join(named, "id", "left")
    return rows.select("id", F.when(F.col("_p").isNull(), F.col("fields")).otherwise(merged).alias("fields"), F.col("_p").isNotNull().alias("patched"))


def missed(registry: DataFrame, patches: DataFrame) -> DataFrame:
    """The ids of patches that no venue has."""
    return patches.select("id").join(registry.select("id"), "id", "left_anti")


def fill_urls(registry: DataFrame, winners: DataFrame, url: str = "whats_on_url") -> DataFrame:
    """``registry`` (id, a url column) with ``outcome``: ``set`` where the url was missing and ``winners`` (id, url) has one, ``kept`` where it wasn't, else null."""
    found = winners.select("id", F.col("url").alias("_new")).filter(F.coalesce("_new", F.lit("")) != "")
    rows = registry.join(found, "id", "left")
    empty = F.coalesce(F.col(url), F.lit("null")).isin("", "null")
    outcome = F.when(F.col("_new").isNull(), None).when(empty, "set").otherwise("kept")
    return rows.withColumn("outcome", outcome).withColumn(url, F.when(F.col("outcome") == "set", F.col("_new")).otherwise(F.col(url))).drop("_new")


def last_of_each(lines: DataFrame, *ties: str) -> DataFrame:
    """(``id``, ``pos``, ``key``, ``value``) lines of settings without the earlier copies of a repeated key; the last one counts, and of equal ``pos`` the first by the columns ``ties``."""
    order = Window.partitionBy("id", "key").orderBy(F.desc("pos"), *ties)
    return lines.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n", *ties)


def repeated(lines: DataFrame) -> DataFrame:
    """(``id``, ``key``, ``n``) of the keys that a venue has more than once."""
    return lines.groupBy("id", "key").agg(F.count("*").alias("n")).filter("n > 1")


def candidates(first: Column, others: Column) -> Column:
    """The urls to try for a venue: distinct, in order, none empty."""
    return F.array_distinct(F.filter(F.concat(F.array(first), F.coalesce(others, F.expr("cast(array() as array<string>)"))), lambda u: F.coalesce(u, F.lit("")) != ""))
