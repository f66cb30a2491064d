"""Date windows, first-wins de-duplication and merging rows into runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_RUN_DAYS = 1095


def overlaps(first: Column, last: Column, start, end) -> Column:
    """Inclusive overlap of [first, last] with [start, end]; as plain comparisons, so it reaches the scan."""
    return (first <= end) & (last >= start)


def overlaps_or_unknown(first: Column, last: Column, start, end) -> Column:
    """As ``overlaps``, but rows missing a date pass."""
    return first.isNull() | last.isNull() | overlaps(first, last, start, end)


def plausible(first: Column, last: Column, most: int = MAX_RUN_DAYS) -> Column:
    """A run of 0 to ``most`` days, or one with a missing side."""
    return first.isNull() | last.isNull() | F.datediff(last, first).between(0, most)


def drop_reason(first: Column, last: Column, start, end) -> Column:
    """Why a row is left out of an extract, or null."""
    return F.when(first.isNull() | last.isNull(), "no parseable dates").when(~overlaps(first, last, start, end), "outside window")


def first_wins(df: DataFrame, keys: list[str], order: list, empty: Column | None = None) -> DataFrame:
    """The first row of each key; rows where ``empty`` holds are all kept.

    A row number with a limit of one is applied before and after the shuffle, so a hot key
    sends one row from each task. Rows without a key pass by the shuffle.
    """
    ranked = df if empty is None else df.filter(~empty)
    ranked = ranked.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")
    return ranked if empty is None else ranked.unionByName(df.filter(empty))


def merge_runs(df: DataFrame, keys: list[str], pos: str, first: str, last: str, longest: list[str] = (), low: list[str] = (), high: list[str] = (), empty: Column | None = None) -> DataFrame:
    """One row per key: earliest first, latest last, longest copy (first of equals), lowest and highest prices (0 is none), else the first row's values.

    Rows where ``empty`` holds are merged with none and pass by the shuffle.
    """
    rest = [c for c in df.columns if c not in {*keys, first, last, *longest, *low, *high}]
    # A price of 0 stays if no row has another.
    price = lambda f, c: F.coalesce(f(F.nullif(F.col(c), F.lit(0))), F.min_by(c, pos)).alias(c)
    aggs = [F.min(first).alias(first), F.max(last).alias(last)]
    aggs += [F.max_by(c, F.struct(F.length(F.coalesce(c, F.lit(""))), -F.col(pos))).alias(c) for c in longest]
    aggs += [price(F.min, c) for c in low] + [price(F.max, c) for c in high]
    aggs += [F.min_by(c, pos).alias(c) for c in rest]
    if empty is None:
        return df.groupBy(*keys).agg(*aggs)
    merged = df.filter(~empty).groupBy(*keys).agg(*aggs)
    return merged.unionByName(df.filter(empty).select(*merged.columns))


def interval_join(left: DataFrame, right: DataFrame, l_first: str, l_last: str, r_first: str, r_last: str, days: int = 30) -> DataFrame:
    """Pairs of overlapping intervals by an equi-join on buckets of days; each pair comes once, from the bucket where its overlap starts."""
    def buckets(df, a, b, name):
        day = lambda c: F.floor(F.datediff(F.col(c), F.lit("1970-01-01")) / days)
        return df.withColumn(name, F.explode(F.sequence(day(a), day(b))))

    joined = buckets(left, l_first, l_last, "_b").join(buckets(right, r_first, r_last, "_rb"), F.col("_b") == F.col("_rb"))
    starts = F.floor(F.datediff(F.greatest(l_first, r_first), F.lit("1970-01-01")) / days)
    return joined.filter(overlaps(F.col(l_first), F.col(l_last), F.col(r_first), F.col(r_last)) & (F.col("_b") == starts)).drop("_b", "_rb")


def asof_preceding(df: DataFrame, by: list[str], order: list, is_target: Column, is_source: Column, value: Column, name: str) -> DataFrame:
    """Target rows with the ``value`` of the last source row before them in ``order``: one sort, no range join."""
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.last(F.when(is_source, value), ignorenulls=True).over(before)).filter(is_target)


def carry_forward(df: DataFrame, by: list[str], order: list, value: Column, name: str) -> DataFrame:
    """The last non-null ``value`` up to and with each row."""
    upto = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(upto))
