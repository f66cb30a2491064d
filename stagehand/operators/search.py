"""Search by meaning: chunks of shows, an index of their vectors, and the best chunk for each phrase, summed over phrases."""

from __future__ import annotations

import logging
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stagehand.functions import text
from stagehand.functions.columns import filled, let, strip

#: Forms of craft by the words that name them, and what is told of each beside the copy.
FORM_CUES = [
    (r"(?i)shadow[\s-]*play", "shadow-play puppetry visual theatre object theatre handmade craft lighting"),
    (r"(?i)\bpuppets?\b|\bpuppetry\b", "puppetry handmade visual theatre craft"),
    (r"(?i)minotaur|labyrinth", "mythic macabre spooky dark adult"),
    (r"(?i)projection|\blanterns?\b|lightshow|lighting design", "lightshow lighting design atmospheric set craft"),
    (r"(?i)\bmasks?\b|\bobject theatre\b", "visual theatre devised craft"),
]
#: Names and areas of venues that win over the registry's.
VENUE_OVERRIDES = {
    "arcola": ("Arcola Theatre", "Dalston, E8"),
    "southwark-playhouse": ("Southwark Playhouse", "Borough, SE1"),
    "wiltons": ("Wilton's Music Hall", "Shadwell, E1"),
    "camden-peoples-theatre": ("Camden People's Theatre", "Euston, NW1"),
    "the-yard": ("The Yard", "Hackney Wick, E9"),
}
POOL, WIDTH = 80, 384


class Unavailable(RuntimeError):
    """An index that is missing or out of step with its events."""


def form_cues(told: Column) -> Column:
    """What is told of the forms that a text names, joined; empty without any."""
    return F.array_join(F.array_compact(F.array(*[F.when(told.rlike(p), F.lit(gloss)) for p, gloss in FORM_CUES])), " ")


def venue_meta(venues: DataFrame) -> DataFrame:
    """(``venue_id``, ``venue_name``, ``venue_area``): the overrides, else the registry's name (or id) and area (or nothing); overrides of venues that it lacks too."""
    fixed = venues.sparkSession.createDataFrame([(k, *v) for k, v in VENUE_OVERRIDES.items()], "venue_id string, _name string, _area string")
    rows = venues.select(F.col("id").alias("venue_id"), "name", "area").join(F.broadcast(fixed), "venue_id", "full_outer")
    return rows.select("venue_id", F.coalesce("_name", F.nullif("name", F.lit("")), "venue_id").alias("venue_name"), F.coalesce("_area", "area", F.lit("")).alias("venue_area"))


def event_chunks(events: DataFrame, venues: DataFrame) -> DataFrame:
    """(``owner``, ``chunk_no``, ``chunk``): title, place and tags in a line, the byline, the copy in slices, and cues of forms. ``events`` has ``idx``."""
    said = lambda c: strip(F.coalesce(c, F.lit("")))
    rows = events.join(venue_meta(venues), "venue_id", "left")
    place = F.array(F.col("title"), F.coalesce("venue_name", "venue_id"), F.col("venue_area"), F.array_join(F.coalesce("tags", F.expr("cast(array() as array<string>)")), " "))
    where = F.array_join(F.filter(place, filled), " \u00b7 ")
    cues = form_cues(text.listing_copy(F.col("title"), said("byline"), F.col("description")))
    chunks = F.filter(F.concat(F.array(where, said("byline")), text.split_copy(F.col("description")), F.array(cues)), filled)
    return rows.select(F.col("idx").alias("owner"), F.posexplode(chunks).alias("chunk_no", "chunk"))


def hashed(told: str, width: int = WIDTH) -> np.ndarray:
    """A vector of a text without a model: its words and their starts, signed and counted by hash."""
    out = np.zeros(width)
    for word in told.lower().split():
        for part in (word, word[:4]):
            h = zlib.crc32(part.encode())
            out[h % width] += 1 if h & 1 << 31 else -1
    return out


def embedded(chunks: DataFrame, embed: Callable[[list[str]], np.ndarray] | None = None) -> DataFrame:
    """``chunks`` with ``vec``, of unit length. ``embed`` turns a batch of texts into a matrix; without one, words are hashed."""
    def run(texts: pd.Series) -> pd.Series:
        rows = np.asarray(embed(texts.tolist()) if embed else [hashed(t) for t in texts], dtype=np.float64).reshape(len(texts), -1)
        return pd.Series(list((rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)).astype(np.float32)))

    return chunks.withColumn("vec", F.pandas_udf(run, T.ArrayType(T.FloatType()))("chunk"))


def checked(index: DataFrame, events: DataFrame) -> DataFrame:
    """``index`` (``owner``, ``vec``), or ``Unavailable`` if its vectors differ in width, lack owners or name an event that isn't there."""
    widths = index.agg(F.min(F.size("vec")), F.max(F.size("vec")), F.count("*"), F.count("owner")).first()
    if not widths[2] or widths[0] != widths[1] or widths[0] < 1:
        raise Unavailable("the vectors are no matrix")
    if widths[3] != widths[2]:
        raise Unavailable(f"owners of {widths[3]} of {widths[2]} vectors")
    lost = index.select("owner").distinct().join(events.select(F.col("idx").alias("owner")), "owner", "left_anti").agg(F.max("owner")).first()[0]
    if lost is not None:
        raise Unavailable(f"no event {lost}")
    return index


def filtered(events: DataFrame, tags: list[str] | None, venue: str | None) -> DataFrame:
    """Events of a venue with any of the tags."""
    if venue:
        events = events.filter(F.col("venue_id") == venue)
    return events.filter(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags]))) if tags else events


def search(events: DataFrame, index: DataFrame, phrases: list[list[float]], tags: list[str] | None = None, venue: str | None = None, limit: int | None = 20) -> DataFrame:
    """The best events (with ``id`` and ``score``) for unit vectors of phrases; without phrases the first ones in their order, with the score 0."""
    chosen = filtered(events, tags, venue).withColumn("id", F.format_string("e%03d", "idx"))
    if not phrases:
        return chosen.withColumn("score", F.lit(0.0)).orderBy("idx").limit(clamp_limit(limit))
    scored = rank(checked(index, events), phrases, "owner", "vec", chosen.select(F.col("idx").alias("owner")))
    best = top(scored, limit, "owner")
    return chosen.join(F.broadcast(best), F.col("idx") == F.col("owner")).drop("owner").orderBy(F.desc("score"), "idx")  # at most 80 rows


def compact(hits: DataFrame) -> DataFrame:
    """What an ordering model is told of hits: id, venue, title, 240 characters of byline, 400 of description, tags, and the place if it is known."""
    told = lambda c: F.coalesce(c, F.lit(""))
    where = F.nullif(F.array_join(F.filter(F.array("venue_name", "venue_area"), filled), " \u00b7 "), F.lit(""))
    return hits.select("id", F.col("venue_id").alias("v"), F.col("title").alias("t"), F.substring(told("byline"), 1, 240).alias("b"), text.compact(told("description")).alias("d"), "tags", where.alias("where"))


def retrieve(events: DataFrame, index: DataFrame, venues: DataFrame, query: str, embed: Callable[[list[str]], np.ndarray] | None = None, tags: list[str] | None = None, venue: str | None = None, limit: int | None = 20, expand=None, order=None) -> DataFrame:
    """Expands a query, takes ``POOL`` hits, has ``order`` (query and compact rows to ids) put the best first, and gives ``limit``.

    A failing ``order``, or one that names no hit, leaves the order of the scores.
    """
    query, limit = (query or "").strip(), clamp_limit(limit)
    if not query:
        return search(events, index, [], tags, venue, limit)
    said = text.expand_query(query, expand)
    matrix = np.asarray(embed(said) if embed else [hashed(p) for p in said], dtype=np.float64)
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
    hits = search(events, index, matrix.tolist(), tags, venue, max(limit, POOL))
    ids: list[str] = []
    if order is not None:
        rows = compact(hits.join(F.broadcast(venue_meta(venues)), "venue_id", "left").orderBy(F.desc("score"), "idx")).collect()  # at most 80 rows
        try:
            ids = [str(i) for i in order(query, [r.asDict() for r in rows]) or []] if len(rows) > 1 else []
        except Exception as e:  # what an injected model raises isn't known
            logging.getLogger(__name__).warning("hits not reordered: %s", e)
    placed = hits.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("score"), "idx")))  # at most 80 rows
    return rerank(placed, ids, "id", "_r").orderBy("place").limit(limit).drop("_r", "place")


def response(hits: DataFrame) -> DataFrame:
    """One row (``ids``, ``scores``, ``count``) of hits in the order of their scores: an answer of the search service."""
    rows = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "idx", "id")))
    return hits.agg(F.transform(rows, lambda r: r["id"]).alias("ids"), F.transform(rows, lambda r: F.round(-r["s"], 4)).alias("scores"), F.count("*").alias("count"))


def parse_tags(raw: str | list[str] | None) -> list[str] | None:
    """Tags of a comma-separated text or a list; None without any."""
    parts = raw.split(",") if isinstance(raw, str) else raw or []
    return [t for p in parts if (t := str(p).strip())] or None


def clamp_limit(limit: int | None) -> int:
    return max(1, min(80, limit or 20))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalise(v: Column) -> Column:
    """Unit length; the norm is at least 1e-12."""
    return let(F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12)), lambda norm: F.transform(v, lambda x: x.cast("double") / norm))


def rank(chunks: DataFrame, phrases: list[list[float]], owner: str, vector: str, owners: DataFrame | None = None) -> DataFrame:
    """(owner, score): for each phrase the best of an owner's chunks, summed; owners without a chunk score -1 a phrase.

    Phrases are at most eight, given by the caller, so they are literals in the plan: the
    chunks are read once and only partial maxima are shuffled.
    """
    scores = [F.max(dot(F.col(vector), F.array(*[F.lit(float(x)) for x in p]))).alias(f"_p{i}") for i, p in enumerate(phrases)]
    found = chunks.groupBy(owner).agg(*scores)
    if owners is not None:
        found = owners.select(owner).join(found, owner, "left")
    total = sum((F.coalesce(F.col(f"_p{i}"), F.lit(-1.0)) for i in range(len(phrases))), F.lit(0.0))
    return found.select(owner, total.alias("score"))


def top(scored: DataFrame, limit: int, *ties: str) -> DataFrame:
    return scored.orderBy(F.desc("score"), *ties).limit(clamp_limit(limit))


def rerank(hits: DataFrame, ids: list, id_col: str, order: str) -> DataFrame:
    """Named ids first, in their order (first mention counts, unknown ones don't), then the rest as before; adds ``place``."""
    at = F.array_position(F.array(*[F.lit(i) for i in ids]), F.col(id_col)) if ids else F.lit(0)
    return hits.withColumn("place", F.row_number().over(Window.orderBy(F.when(at > 0, at).asc_nulls_last(), order)))
