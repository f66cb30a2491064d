"""Listing rows from fetched pages and API answers, one function a strategy.

Each takes ``venues`` (see ``VENUE``; small, but joined like any table) and ``pages``
(url, body), and returns ``COLUMNS``; ``pos`` is a row's place on its page. Fetching is not done here: pages come from a table.
"""

from __future__ import annotations

import json
import re
from functools import reduce
from urllib.parse import quote, urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stagehand.functions import linked, markup
from stagehand.functions.dates import iso_day, parse_range
from stagehand.functions.text import unescaped
from stagehand.sources.details import dated_clusters
from stagehand.sources.sections import sections

VENUE = "id string, name string, area string, strategy string, fetch_method string, render boolean, render_wait string, whats_on_url string, endpoint string, dates_field string, show_url_pattern string, lookahead_weeks int, seasonal boolean, skip_stage2 boolean, detail_dates string, exclude array<string>, space_allow array<string>, require_space boolean, selectors map<string,string>"
COLUMNS = ["venue_id", "pos", "title", "credits", "space", "url", "first_date", "last_date", "description", "venue_tags", "source"]
STRATEGIES = "auto jsonld selectors dated_clusters wp_rest sanity immersive_rumours skip".split()


def registry(spark: SparkSession, path: str) -> DataFrame:
    """Venues of a YAML or JSON registry: a list, or an object with ``venues``. Keys that the schema lacks are left out, missing ones null. YAML needs PyYAML."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())  # one small file of settings
    if path.endswith(".json"):
        rows = json.loads(text)
    else:
        import yaml

        rows = yaml.safe_load(text)
    rows = rows.get("venues") if isinstance(rows, dict) else rows
    schema = spark.createDataFrame([], VENUE).schema
    return spark.createDataFrame([tuple(_flat(r or {}).get(f.name) for f in schema) for r in rows or []], schema)


#: What a content API is asked for if the venue doesn't say.
SANITY_QUERY = '*[_type=="event" && defined(duration.end) && duration.end >= now()]| order(duration.start asc){title, description, duration, "slug": slug.current}'


def _flat(venue: dict) -> dict:
    """A venue with its nested settings in the columns of ``VENUE``."""
    out = dict(venue)
    sel = dict(venue.get("selectors") or {})
    for name in ("space_allow", "exclude"):
        said = sel.pop(name, None) or venue.get(name)
        out[name] = [str(x) for x in said] if said else None
    out["selectors"] = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in sel.items() if v is not None}
    out["area"] = venue.get("area") or (venue.get("location") or {}).get("area")
    out["detail_dates"] = (venue.get("detail_selectors") or {}).get("dates")
    if rest := venue.get("wp_rest"):
        base = rest.get("endpoint")
        out["endpoint"] = f"{base}{'&' if '?' in base else '?'}per_page={int(rest.get('per_page') or 50)}" if base else None
        out["dates_field"] = rest.get("dates_field")
    if api := venue.get("sanity"):
        query = quote(api.get("query") or SANITY_QUERY)
        where = f"v{api.get('api_version') or '2021-10-21'}/data/query/{api.get('dataset') or 'production'}"
        out["endpoint"] = f"https://{api['project_id']}.api.sanity.io/{where}?query={query}" if api.get("project_id") else None
    return out


def dump(spark: SparkSession, path: str) -> DataFrame:
    """The events of a JSON dump ``{"events": [...]}``, in order by ``pos``; dates as dates."""
    rows = spark.read.json(path, multiLine=True).select(F.posexplode("events").alias("pos", "e")).select("pos", "e.*")
    for name in ("first_date", "last_date"):
        rows = rows.withColumn(name, iso_day(F.col(name)) if name in rows.columns else F.lit(None).cast("date"))
    return rows


def fresh(pages: DataFrame, as_of: Column, hours: int) -> DataFrame:
    """The latest copy of each url fetched within ``hours`` of ``as_of``; one row a task is shuffled for each url."""
    rest = [c for c in pages.columns if c != "url"]
    recent = pages.filter(F.col("fetched_at") > as_of - F.make_interval(hours=F.lit(hours)))
    return recent.groupBy("url").agg(F.max_by(F.struct(*rest), "fetched_at").alias("p")).select("url", "p.*")


def strategy(venues: DataFrame) -> Column:
    """The named strategy; without one, ``skip`` for pages that need a browser or have no url, else ``auto``."""
    none = lambda c: F.coalesce(c, F.lit("")) == ""
    return F.when(~none(venues["strategy"]), venues["strategy"]).when((venues["fetch_method"] == "js_rendered") | none(venues["whats_on_url"]), "skip").otherwise("auto")


def seed(spark: SparkSession, venues: dict[str, dict]) -> DataFrame:
    """Rows of hand-kept shows in ``COLUMNS``: for each venue id a ``base`` url, ``trailing_slash`` and ``shows`` of (title, credits, space, first date, last date, slug, tags, description)."""
    rows = []
    for venue, data in venues.items():
        end = "/" if data.get("trailing_slash", True) else ""
        for pos, (title, credits, space, first, last, slug, tags, told) in enumerate(data["shows"]):
            rows.append((venue, pos, title, credits, space, f"{data['base']}{slug}{end}" if slug else data["base"], first, last, told, tags, "seed"))
    kinds = dict(zip(COLUMNS, "string bigint string string string string date date string array<string> string".split()))
    return spark.createDataFrame(rows, ", ".join(f"{k} {'string' if v == 'date' else v}" for k, v in kinds.items())).select(*[iso_day(F.col(c)).alias(c) if kinds[c] == "date" else F.col(c) for c in COLUMNS])


def jsonld(venues: DataFrame, pages: DataFrame, as_of: Column) -> DataFrame:
    """Rows of schema.org events; the end is the start if none is given, free text is read as a range of dates."""
    at = venues.select(F.col("id").alias("venue_id"), "whats_on_url").join(pages.select("url", "body"), F.col("whats_on_url") == F.col("url"))
    rows = linked.with_objects(at, "body").select("venue_id", "whats_on_url", F.posexplode(linked.events(F.col("_nodes"))).alias("pos", "e")).filter(F.coalesce("e.title", F.lit("")) != "")
    start = iso_day(F.col("e.start"))
    written = parse_range(F.concat_ws(" ", "e.start", "e.end"), as_of)
    rows = rows.select("*", start.alias("s"), iso_day(F.coalesce("e.end", "e.start")).alias("t"), written.alias("w"))
    return rows.select(
        "venue_id", "pos", "e.title", F.lit(None).cast("string").alias("credits"), F.coalesce(F.nullif("e.url", F.lit("")), "whats_on_url").alias("url"),
        F.coalesce("s", "w.first_date").alias("first_date"), F.when(F.col("s").isNull(), F.col("w.last_date")).otherwise(F.col("t")).alias("last_date"),
        "e.description", F.lit("jsonld").alias("source"),
    )


def plain(markup: Column) -> Column:
    """Text of a fragment of markup, spaces joined."""
    bare = F.regexp_replace(F.regexp_replace(markup, "<[^>]*>", " "), r"\s+", " ")
    return F.nullif(F.trim(unescaped(bare)), F.lit(""))


def _rendered(item: Column, key: str) -> Column:
    """A field of a REST item: its ``rendered`` text, or itself if it is no object."""
    value = F.get_json_object(item, f"$.{key}")
    return F.nullif(F.coalesce(F.get_json_object(item, f"$.{key}.rendered"), F.when(~value.startswith("{"), value)), F.lit(""))


def wp_rest(venues: DataFrame, pages: DataFrame, as_of: Column) -> DataFrame:
    """Rows of a REST collection: a JSON list; other answers give none. The range of dates is in the field the venue names."""
    at = venues.select(F.col("id").alias("venue_id"), "whats_on_url", "endpoint", "dates_field").join(pages.select("url", "body"), F.col("endpoint") == F.col("url"))
    rows = at.filter(F.ltrim("body").startswith("[")).select("venue_id", "whats_on_url", "dates_field", F.posexplode(F.from_json("body", "array<string>")).alias("pos", "item"))
    item = F.col("item")
    dates = F.element_at(F.from_json(item, "map<string,string>"), F.col("dates_field"))
    rows = rows.select("*", F.coalesce(_rendered(item, "title"), F.get_json_object(item, "$.production_title")).alias("title"), parse_range(dates, as_of).alias("w")).filter(F.coalesce("title", F.lit("")) != "")
    return rows.select("venue_id", "pos", "title", _rendered(item, "producer").alias("credits"), F.coalesce(F.get_json_object(item, "$.link"), "whats_on_url").alias("url"), "w.first_date", "w.last_date", plain(_rendered(item, "excerpt")).alias("description"), F.lit("wp_rest").alias("source"))


RESULT = "result array<struct<title:string,description:string,slug:string,duration:struct<start:string,end:string>>>"


def sanity(venues: DataFrame, pages: DataFrame, as_of: Column) -> DataFrame:
    """Rows of a content API's ``result``. A description under 120 characters that ends in "theatre" says nothing and is left out."""
    at = venues.select(F.col("id").alias("venue_id"), "whats_on_url", "endpoint", "show_url_pattern").join(pages.select("url", "body"), F.col("endpoint") == F.col("url"))
    rows = at.select("venue_id", "whats_on_url", "show_url_pattern", F.posexplode(F.from_json("body", f"struct<{RESULT.replace('result ', 'result:', 1)}>")["result"]).alias("pos", "e")).filter(F.coalesce("e.title", F.lit("")) != "")
    start, said = iso_day(F.col("e.duration.start")), F.nullif(F.col("e.description"), F.lit(""))
    pattern = F.coalesce("show_url_pattern", F.concat(F.rtrim("whats_on_url", F.lit("/")), F.lit("/{slug}")))
    stub = F.regexp_replace(F.lower(said), "[ .]+$", "").endswith("theatre") & (F.length(said) < 120)
    return rows.select(
        "venue_id", "pos", "e.title", F.lit(None).cast("string").alias("credits"), F.when(F.coalesce("e.slug", F.lit("")) != "", F.replace(pattern, F.lit("{slug}"), F.col("e.slug"))).otherwise(F.col("whats_on_url")).alias("url"),
        start.alias("first_date"), F.coalesce(iso_day(F.col("e.duration.end")), start).alias("last_date"), F.when(~stub, said).alias("description"), F.lit("sanity").alias("source"),
    )


CARD = T.ArrayType(T.StructType([*(T.StructField(name, T.StringType()) for name in ("title", "credits", "space", "url", "dates", "description")), T.StructField("tags", T.ArrayType(T.StringType()))]))
ADDRESS = re.compile(r"goToUrl\('([^']+)'")


def _card(card: markup.Node, by: dict[str, str], base: str) -> dict:
    """The fields of one card; those without a selector or a match are None."""
    nodes = card.below()
    first = lambda sel: next(markup.fitting(nodes, sel), None) if sel else None

    def said(sel: str | None) -> str | None:
        node = first(sel)
        return None if node is None else node.text() or (node.attrs.get("alt", "").strip() if node.tag == "img" else "") or None

    link = first(by.get("link")) or (card if card.tag == "a" and card.attrs.get("href") else first("a[href]"))
    href = link.attrs.get("href", "") if link else ""
    if not href or href.startswith("#"):
        found = ADDRESS.search(" ".join(card.attrs.values()))
        href = found.group(1) if found else ""
    blurb = first(by.get("blurb"))
    drop = {id(n) for n in markup.select(blurb, by["blurb_strip"])} if blurb and by.get("blurb_strip") else set()
    tags = [n.text() for n in markup.fitting(nodes, by["tags"])] if by.get("tags") else []
    return {
        "title": said(by.get("title")), "credits": said(by.get("credits") or by.get("byline")), "space": said(by.get("space")),
        "url": urljoin(base, href) if href else None, "dates": said(by["dates"]) if by.get("dates") else card.text(),
        "description": (blurb.text(drop) or None) if blurb else None, "tags": list(dict.fromkeys(t for t in tags if t)),
    }


@F.pandas_udf(CARD)
def cards(pages: pd.Series, selectors: pd.Series, bases: pd.Series) -> pd.Series:
    """The cards of each page by its venue's selectors: a tree search, which no built-in does."""
    def one(page, by, base):
        by = dict(by) if by is not None else {}
        return [_card(c, by, base or "") for c in markup.select(markup.tree(page or ""), by["show_card"])] if by.get("show_card") else []

    return pd.Series([one(*x) for x in zip(pages, selectors, bases, strict=True)])


def selectors(venues: DataFrame, pages: DataFrame, as_of: Column) -> DataFrame:
    """Rows of cards. Rooms outside ``space_allow``, missing rooms where one is required, and titles or urls with an ``exclude`` text go."""
    at = venues.select(F.col("id").alias("venue_id"), "whats_on_url", "selectors", "exclude", "space_allow", F.coalesce("require_space", F.lit(False)).alias("require_space")).join(pages.select("url", "body"), F.col("whats_on_url") == F.col("url"))
    rows = at.select("*", F.posexplode(cards("body", "selectors", "whats_on_url")).alias("pos", "e")).filter(F.col("e.title").isNotNull())
    space = F.lower(F.coalesce("e.space", F.lit("")))
    blob = F.lower(F.concat_ws(" ", "e.title", "e.url"))
    holds = lambda names, where: F.exists(F.coalesce(names, F.array().cast("array<string>")), lambda x: where.contains(F.lower(x)))
    open_to_all = F.coalesce(F.size("space_allow"), F.lit(0)) <= 0
    kept = rows.filter((~F.col("require_space") | (space != "")) & (open_to_all | holds(F.col("space_allow"), space)) & ~holds(F.col("exclude"), blob))
    cut = F.coalesce(F.element_at("selectors", "title_cut_dates"), F.lit("")).isin("", "false", "False")
    title = F.when(cut, F.col("e.title")).otherwise(F.trim(F.get(F.split("e.title", r"\s+(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)\b", 2), 0)))
    kept = kept.withColumn("w", parse_range(F.col("e.dates"), as_of))
    return kept.select("venue_id", "pos", title.alias("title"), "e.credits", "e.space", F.coalesce("e.url", "whats_on_url").alias("url"), "w.first_date", "w.last_date", "e.description", F.col("e.tags").alias("venue_tags"), F.lit("selectors").alias("source"))


def whole(rows: DataFrame) -> DataFrame:
    """All of ``COLUMNS``; fields that a strategy doesn't give are null."""
    if "space" not in rows.columns:
        rows = rows.withColumn("space", F.lit(None).cast("string"))
    if "venue_tags" not in rows.columns:
        rows = rows.withColumn("venue_tags", F.lit(None).cast("array<string>"))
    return rows.withColumn("pos", F.col("pos").cast("long")).select(*COLUMNS)


def extract(venues: DataFrame, pages: DataFrame, as_of: Column) -> DataFrame:
    """Rows of every venue by its strategy; ``auto`` reads linked data, or cards where there is none. Raises for a strategy not in ``STRATEGIES``."""
    named = venues.withColumn("_by", strategy(venues))
    unknown = named.filter(~F.col("_by").isin(STRATEGIES)).select("id", "_by").first()
    if unknown:
        raise ValueError(f"unknown strategy {unknown['_by']!r} on {unknown['id']}")
    of = lambda *names: named.filter(F.col("_by").isin(*names))
    linked = jsonld(of("auto", "jsonld"), pages, as_of)
    bare = of("auto").join(linked.select(F.col("venue_id").alias("id")), "id", "left_anti")
    read = [linked, selectors(of("selectors").unionByName(bare.select(*named.columns)), pages, as_of), dated_clusters(of("dated_clusters"), pages, as_of), sections(of("immersive_rumours"), pages, as_of), wp_rest(of("wp_rest"), pages, as_of), sanity(of("sanity"), pages, as_of)]
    return reduce(DataFrame.unionByName, map(whole, read))
