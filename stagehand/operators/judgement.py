"""Judging records with a cache: only those whose content is new reach a classifier."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagehand.functions import text
from stagehand.operators import snapshots
from stagehand.session import written

#: The tags that a judgement may give.
ALLOWED = (
    "theatre musical stand-up comedy concert opera dance circus immersive puppetry cabaret magic spoken-word talk class social exhibition"
).split()
CACHE = "fp string, keep boolean, tags array<string>, star boolean, why string, last_seen date"
VERDICT = ["keep", "tags", "star", "why"]
#: A classifier: a batch of compact rows (``i``, ``v``, ``t``, ``b``, ``d``, ``tags``) to verdicts (``i``, ``keep``, ``tags``, ``star``, ``why``).
Classifier = Callable[[list[dict]], list[dict]]


@dataclass
class Taste:
    """What the judgements depend on; a change of it asks about every record again."""

    model: str = ""
    allowed: list[str] = field(default_factory=lambda: list(ALLOWED))
    drop: str = ""
    interests: str = ""
    batch: int = 20
    weeks: int = 12


def fingerprint(taste: Taste) -> Column:
    """The key of a record's judgement: its content and the taste."""
    told = F.lit("|".join([taste.model, *taste.allowed, taste.drop, taste.interests]))
    return snapshots.fingerprint(told, F.col("venue_id"), F.col("title"), F.col("byline"), F.col("description"))


def clamped(keep: Column, tags: Column, star: Column, why: Column, allowed: list[str]) -> Column:
    """A verdict (keep, tags, star, why) with allowed tags in their order, "theatre" for a kept row without any, a star only for kept rows, and 120 characters of reason."""
    keep = F.coalesce(keep, F.lit(False))
    good = F.filter(F.coalesce(tags, F.expr("cast(array() as array<string>)")), lambda t: t.isin(allowed))
    given = F.when(keep & (F.size(good) == 0), F.array(F.lit(text.PLAIN_FORM))).otherwise(good)
    return F.struct(keep.alias("keep"), given.alias("tags"), (F.coalesce(star, F.lit(False)) & keep).alias("star"), F.substring(F.coalesce(why, F.lit("")), 1, 120).alias("why"))


def compact(rows: DataFrame) -> DataFrame:
    """What a classifier is told of a row: venue, title, 240 characters of byline and 400 of description, tags."""
    told = lambda c: F.coalesce(c, F.lit(""))
    return rows.select("fp", F.col("venue_id").alias("v"), F.col("title").alias("t"), F.substring(told("byline"), 1, 240).alias("b"), text.compact(told("description")).alias("d"), F.coalesce("tags", F.expr("cast(array() as array<string>)")).alias("tags"))


def classified(rows: DataFrame, call: Classifier, size: int = 20) -> DataFrame:
    """(``fp``, keep, tags, star, why) of the rows that ``call`` answers, asked in batches of ``size``; each task asks for its own rows."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), size):
                part = frame.iloc[start : start + size]
                batch = [{"i": i, **{k: list(x) if k == "tags" else x for k, x in row.items()}} for i, row in enumerate(part.drop(columns="fp").to_dict("records"))]
                said = {int(r["i"]): r for r in call(batch) if "i" in r}
                found = [(fp, bool(said[i].get("keep")), list(said[i].get("tags") or []), bool(said[i].get("star")), said[i].get("why") or "") for i, fp in enumerate(part["fp"]) if i in said]
                yield pd.DataFrame(found, columns=["fp", *VERDICT])

    return compact(rows).mapInPandas(run, "fp string, keep boolean, tags array<string>, star boolean, why string")


@dataclass
class Refined:
    """``kept`` records, the next ``cache`` and one row of ``stats``."""

    kept: DataFrame
    cache: DataFrame
    stats: DataFrame


def judged(events: DataFrame, cache: DataFrame, taste: Taste, call: Classifier | None = None) -> DataFrame:
    """Events with ``fp``, ``source`` (language, cache, asked or none) and ``verdict`` (null: none).

    Copies that aren't English are dropped without asking; a cached judgement is used as long as
    the content and the taste are the same; the rest is asked, once for each content. Rows that
    stay unanswered keep their tags.
    """
    marked = events.withColumn("fp", fingerprint(taste)).withColumn("_english", text.is_english(text.listing_copy(F.col("title"), F.col("byline"), F.col("description"))))
    known = cache.select("fp", F.struct(*VERDICT).alias("_hit"))
    looked = marked.join(known, "fp", "left")
    if call is not None:
        asked = looked.filter(F.col("_english") & F.col("_hit").isNull()).dropDuplicates(["fp"])
        looked = looked.join(classified(asked, call, taste.batch).select("fp", F.struct(*VERDICT).alias("_said")), "fp", "left")
    else:
        looked = looked.withColumn("_said", F.col("_hit"))
    said = F.coalesce("_hit", "_said")
    foreign = F.struct(F.lit(False).alias("keep"), F.expr("cast(array() as array<string>)").alias("tags"), F.lit(False).alias("star"), F.lit("not English").alias("why"))
    verdict = F.when(~F.col("_english"), foreign).when(said.isNotNull(), clamped(said["keep"], said["tags"], said["star"], said["why"], taste.allowed))
    source = F.when(~F.col("_english"), "language").when(F.col("_hit").isNotNull(), "cache").when(F.col("_said").isNotNull(), "asked").otherwise("none")
    return looked.withColumns({"verdict": verdict, "source": source}).select(*events.columns, "fp", "source", "verdict")


def applied(rows: DataFrame) -> DataFrame:
    """``judged`` rows that stay, with the tags of their verdict."""
    kept = rows.filter(F.col("verdict").isNull() | F.col("verdict.keep"))
    return kept.withColumn("tags", F.when(F.col("verdict").isNotNull(), F.col("verdict.tags")).otherwise(F.col("tags"))).drop("fp", "source", "verdict", "prestar")


def statistics(rows: DataFrame) -> DataFrame:
    """One row: cache hits, rows asked about, dropped and retagged."""
    verdict, keeps = F.col("verdict"), F.col("verdict.keep")
    same = F.coalesce("tags", F.expr("cast(array() as array<string>)")) == F.col("verdict.tags")
    return rows.agg(
        F.count("*").alias("events"), F.count_if(F.col("source") == "cache").alias("cache_hits"), F.count_if(F.col("source") == "asked").alias("asked"),
        F.count_if(verdict.isNotNull() & ~keeps).alias("dropped"), F.count_if(verdict.isNotNull() & keeps & ~same).alias("retagged"),
    )


def next_cache(rows: DataFrame, cache: DataFrame, as_of: Column, weeks: int = 12, prune: bool = True) -> DataFrame:
    """The cache with this run's verdicts, seen at ``as_of``, in place of older ones; entries unseen for ``weeks`` go unless ``prune`` is off."""
    new = rows.filter("verdict is not null").select("fp", "verdict.*", as_of.alias("last_seen")).dropDuplicates(["fp"])
    merged = snapshots.upsert(cache.select(*new.columns), new, "fp")
    return snapshots.prune(merged, rows.select("fp"), "fp", "last_seen", as_of, weeks) if prune and weeks > 0 else merged


def refine(events: DataFrame, cache: DataFrame, taste: Taste, as_of: Column, call: Classifier | None = None, prune: bool = True) -> Refined:
    """Keeps, drops and retags ``events``. Rows are judged once: all three results read them from a written table."""
    rows = written(judged(events, cache, taste, call), "judged")
    return Refined(applied(rows), next_cache(rows, cache, as_of, taste.weeks, prune), statistics(rows))
