"""The reader's page: what is shown, in which order, and the facets beside it."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The order of known tags; others follow by name.
TAG_ORDER = "theatre concert comedy class stand-up dance talk musical spoken-word film social cabaret opera puppetry sport exhibition immersive magic circus".split()
#: How much theatre and starred shows weigh in a shuffle.
THEATRE_WEIGHT, STAR_WEIGHT = 4, 5


@F.pandas_udf(T.StringType())
def decomposed(texts: pd.Series) -> pd.Series:
    """Compatibility decomposition, which no built-in does."""
    return texts.map(lambda t: unicodedata.normalize("NFKD", t), na_action="ignore")


def slug(title: Column, most: int = 80) -> Column:
    """Lower case, runs of others than a-z and 0-9 as one dash, none at the ends, ``most`` characters."""
    dashed = F.regexp_replace(decomposed(F.lower(title)), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(dashed, "^-|-$", ""), 1, most)


def stable_key(venue: Column, title: Column) -> Column:
    """A show's key that outlives its place in an extract."""
    return F.concat(venue, F.lit("::"), slug(title))


def current(events: DataFrame, as_of: Column) -> DataFrame:
    """Shows that haven't ended; those without an end are gone too."""
    return events.filter(F.col("last_date") >= as_of)


def visible(events: DataFrame, binned: DataFrame, starred: DataFrame | None = None, mode: str = "all", tags: list[str] = (), venues: list[str] = (), first=None, last=None, subset: list[str] | None = None) -> DataFrame:
    """What a reader sees. ``events`` has ``key`` and ``id``; ``binned`` and ``starred`` are the reader's keys.

    The two piles are shown whole. Otherwise any of the tags, one of the venues, an overlap with
    [first, last], the ids of ``subset`` in its order (in ``place``), and nothing binned.
    """
    if mode in ("starred", "binned"):
        return events.join((starred if mode == "starred" else binned).select("key"), "key", "left_semi")
    shown = events
    if tags:
        shown = shown.filter(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    if venues:
        shown = shown.filter(F.col("venue_id").isin(*venues))
    if first is not None and last is not None:
        shown = shown.filter((F.col("first_date") <= F.lit(last)) & (F.col("last_date") >= F.lit(first)))
    if subset is not None:
        place = F.array_position(F.array(*[F.lit(i) for i in subset]).cast("array<string>"), F.col("id"))
        shown = shown.withColumn("place", place).filter("place > 0").orderBy("place")
    return shown.join(binned.select("key"), "key", "left_anti")


def tag_facet(events: DataFrame) -> DataFrame:
    """(``tag``, ``n``, ``place``) of all tags, known ones first in their order."""
    counted = events.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    known = F.nullif(F.array_position(F.array(*[F.lit(t) for t in TAG_ORDER]), F.col("tag")), F.lit(0))
    return counted.withColumn("place", F.row_number().over(Window.orderBy(known.asc_nulls_last(), "tag")))  # a row for each tag


def venue_facet(events: DataFrame) -> DataFrame:
    """(``venue_id``, ``name``, ``n``) of all venues; the one without a name has its id."""
    name = F.coalesce("venue_name", "venue_id")
    return events.groupBy("venue_id").agg(F.min(name).alias("name"), F.count("*").alias("n"))


def shuffled(events: DataFrame, starred: DataFrame, seed: int) -> DataFrame:
    """``events`` in a random order that favours theatre and starred shows: by a uniform number to the power 1 / weight. The same ``seed`` gives the same order."""
    marked = events.join(starred.select("key", F.lit(True).alias("_star")), "key", "left")
    weight = F.when(F.array_contains("tags", "theatre"), THEATRE_WEIGHT).otherwise(1) * F.when(F.col("_star"), STAR_WEIGHT).otherwise(1)
    drawn = F.conv(F.substring(F.md5(F.concat_ws("|", "key", F.lit(str(seed)))), 1, 13), 16, 10).cast("double")
    uniform = (drawn + 0.5) / float(1 << 52)
    return marked.withColumn("_w", F.pow(uniform, 1 / weight)).orderBy(F.desc("_w"), "key").drop("_w", "_star")


def reader_row() -> Column:
    """What a pile keeps of a show, so that it means something after the show has left the extract."""
    return F.struct("title", F.col("venue_name").alias("venue"), "url", F.col("first_date").alias("from"), F.col("last_date").alias("to"))
