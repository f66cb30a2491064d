"""Judgement caches, snapshot differences, guards and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fingerprint(*columns: Column) -> Column:
    """A stable key of a row's content."""
    return F.sha2(F.to_json(F.struct(*[F.coalesce(c.cast("string"), F.lit("")).alias(f"c{i}") for i, c in enumerate(columns)])), 256)


def lookup(rows: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Rows with their cached judgement, or nulls."""
    return rows.join(cache, key, "left")


def pending(rows: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Rows without a cached judgement."""
    return rows.join(cache.select(key), key, "left_anti")


def prune(cache: DataFrame, seen: DataFrame, key: str, last_seen: str, as_of: Column, weeks: int = 12) -> DataFrame:
    """Entries seen in this run or in the last ``weeks``; those without a date go."""
    marked = cache.join(seen.select(key).distinct().withColumn("_seen", F.lit(True)), key, "left")
    return marked.filter(F.col("_seen") | (F.col(last_seen) >= F.date_sub(as_of, 7 * weeks))).drop("_seen")


def upsert(cache: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The cache with new entries in place of old ones."""
    return cache.join(new.select(key), key, "left_anti").unionByName(new)


def difference(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keys ``added`` or ``gone``, in ``change``."""
    added = new.select(*keys).distinct().join(old.select(*keys), keys, "left_anti").withColumn("change", F.lit("added"))
    return added.unionByName(old.select(*keys).distinct().join(new.select(*keys), keys, "left_anti").withColumn("change", F.lit("gone")))


def shrink_reason(old: DataFrame, new: DataFrame, key: str, exempt: DataFrame | None = None, ratio: float = 0.5) -> DataFrame:
    """One row (old_rows, new_rows, vanished, reason): why publishing is refused, or null. An empty old snapshot allows all."""
    gone = old.select(key).distinct().join(new.select(key), key, "left_anti")
    if exempt is not None:
        gone = gone.join(exempt.select(key), key, "left_anti")
    counts = old.agg(F.count("*").alias("old_rows")).crossJoin(new.agg(F.count("*").alias("new_rows"))).crossJoin(gone.agg(F.count("*").alias("vanished")))  # three single rows
    small = (F.col("old_rows") > 0) & (F.col("new_rows") < ratio * F.col("old_rows"))
    return counts.withColumn("reason", F.when(small, "shrunk").when((F.col("old_rows") > 0) & (F.col("vanished") > 0), "vanished"))


def audit(df: DataFrame, rules: list[tuple[str, Column]], keep: list[str], stop: str | None = None) -> DataFrame:
    """A row for each rule that a row breaks; a row that breaks ``stop`` breaks nothing else."""
    hits = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules]))
    if stop:
        hits = F.when(F.array_contains(hits, stop), F.array(F.lit(stop))).otherwise(hits)
    return df.select(*keep, F.explode(hits).alias("rule"))


def top_groups(df: DataFrame, by: str, group: str, most: int = 4) -> DataFrame:
    """The ``most`` groups with the most rows for each ``by``; counts are summed before the shuffle."""
    counted = df.groupBy(by, group).agg(F.count("*").alias("n"))
    return counted.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), group))).filter(F.col("place") <= most)
