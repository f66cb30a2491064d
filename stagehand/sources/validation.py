"""Which strategy reads a venue best: every promising one is tried on the pages at hand and its rows are scored."""

from __future__ import annotations

from functools import reduce
from urllib.parse import quote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagehand.functions.columns import filled
from stagehand.sources import listings, probes

#: The selectors beside a guessed card, and how many rows a REST collection is asked for.
GUESSED = {"title": "h2, h3, h4, a", "dates": "[class*=date], time, .edate, .EV_ListDate", "link": "a[href]"}
PER_PAGE = 20
GUESS = "selectors:probe"


def tries(venues: DataFrame, signals: DataFrame) -> DataFrame:
    """Venues (as ``listings.VENUE``) with ``attempt``, a row for each strategy worth trying, its settings completed from the ``signals`` of ``probes.probe``.

    Linked data always; the venue's own selectors; the signature that repeats most as cards; a
    content API or a REST collection that the venue names or its page shows.
    """
    seen = signals.select("id", F.get("cards", 0)["signature"].alias("_card"), "sanity_project", F.get("wp_rest", 0)["endpoint"].alias("_rest"), F.coalesce("final_url", "url").alias("_at"))
    rows = venues.join(seen, "id", "left")
    named = lambda name: (F.col("strategy") == name) & filled(F.col("endpoint"))
    guess = F.map_from_entries(F.array(F.struct(F.lit("show_card"), F.concat(F.lit("."), F.ltrim("_card", F.lit(".")))), *[F.struct(F.lit(k), F.lit(v)) for k, v in GUESSED.items()]))
    api = F.concat(F.lit("https://"), "sanity_project", F.lit(f".api.sanity.io/v2021-10-21/data/query/production?query={quote(listings.SANITY_QUERY)}"))
    rest = F.concat("_rest", F.when(F.col("_rest").contains("?"), "&").otherwise("?"), F.lit(f"per_page={PER_PAGE}"))

    def told(attempt: str, when: Column, **other: Column) -> DataFrame:
        return rows.filter(when).select(*[other[c].alias(c) if c in other else F.col(c) for c in venues.columns], F.lit(attempt).alias("attempt"))

    return reduce(
        DataFrame.unionByName,
        [
            told("jsonld", F.lit(True)),
            told("selectors", filled(F.element_at("selectors", "show_card"))),
            told(GUESS, filled(F.col("_card")), selectors=guess, require_space=F.lit(False)),
            told("sanity", named("sanity")),
            told("sanity", ~F.coalesce(named("sanity"), F.lit(False)) & filled(F.col("sanity_project")), endpoint=api, show_url_pattern=F.concat(probes.root(F.col("_at")), F.lit("/events/{slug}"))),
            told("wp_rest", named("wp_rest")),
            told("wp_rest", ~F.coalesce(named("wp_rest"), F.lit(False)) & filled(F.col("_rest")), endpoint=rest),
        ],
    )


def attempts(tried: DataFrame, pages: DataFrame, as_of: Column) -> DataFrame:
    """The listing rows (``listings.COLUMNS`` and ``attempt``) of every try."""
    ways = {"jsonld": listings.jsonld, "selectors": listings.selectors, GUESS: listings.selectors, "sanity": listings.sanity, "wp_rest": listings.wp_rest}
    of = lambda name: tried.filter(F.col("attempt") == name).drop("attempt")
    return reduce(DataFrame.unionByName, [listings.whole(way(of(name), pages, as_of)).withColumn("attempt", F.lit(name)) for name, way in ways.items()])


def validate(venues: DataFrame, signals: DataFrame, pages: DataFrame, as_of: Column) -> DataFrame:
    """One row a venue: ``probe`` (the recommended strategy), ``registry`` (its own), ``best``, ``agrees``, ``probe_works``, and ``scores`` of every try.

    The probe agrees if it names the best try, or one with as many useful rows. Selectors that
    the venue lacks are stood for by the guessed ones. A try without rows scores zeros.
    """
    tried = tries(venues, signals)
    rows = attempts(tried, pages, as_of).join(venues.select(F.col("id").alias("venue_id"), "whats_on_url"), "venue_id")
    counted = probes.score(rows, F.col("whats_on_url"), "venue_id", "attempt").withColumnRenamed("venue_id", "id")
    numbers = [c for c in counted.columns if c not in ("id", "attempt")]
    scored = tried.select("id", "attempt").distinct().join(counted, ["id", "attempt"], "left").fillna(0, numbers)
    best = probes.best_attempt(scored, "id", "attempt")
    listed = scored.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("attempt", *numbers))).alias("scores"))
    out = venues.select("id", F.coalesce(F.nullif("strategy", F.lit("")), F.lit("auto")).alias("registry")).join(signals.select("id", F.coalesce("recommended_strategy", F.lit("skip")).alias("probe")), "id", "left")
    out = out.join(best, "id", "left").join(listed, "id", "left")
    has = lambda name: F.exists("scores", lambda s: s["attempt"] == name)
    asked = F.when((F.col("probe") == "selectors") & ~has(F.lit("selectors")), GUESS).otherwise(F.col("probe"))
    useful = lambda name: F.get(F.filter("scores", lambda s: s["attempt"] == name), 0)["useful"]
    works = F.coalesce(useful(asked) > 0, F.lit(False))
    named = F.coalesce(F.col("probe") == F.substring_index("best", ":", 1), F.lit(False))
    same = works & F.coalesce(useful(asked) == useful(F.col("best")), F.lit(False))
    return out.select("id", "probe", "registry", "best", (named | same).alias("agrees"), works.alias("probe_works"), "scores")
