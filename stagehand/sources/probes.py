"""Where a site lists its events: sitemaps, REST types and links of the navigation, from fetched pages."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stagehand.functions import linked, markup
from stagehand.operators import patches

#: Paths of sitemaps, REST types of listings and labels of links to them.
SITEMAPS = ["/sitemap.xml", "/sitemap_index.xml", "/wp-sitemap.xml"]
LISTING_TYPES = ["productions", "production", "whatson", "whats-on", "event", "events", "show", "shows", "performance", "performances"]
NAV_LABEL = r"(?i)^(?:what'?s\s*on|now\s*&\s*next|events?|programme|program|listings?|shows?|productions?|calendar)$"


def root(url: Column) -> Column:
    """Scheme and host."""
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)


def sitemaps(sites: DataFrame, pages: DataFrame) -> DataFrame:
    """(``base``, ``sitemap``): the first path of each site at which ``pages`` has markup; null if there is none."""
    paths = sites.select("base", F.posexplode(F.array(*[F.concat(root(F.col("base")), F.lit(p)) for p in SITEMAPS])).alias("n", "url"))
    found = paths.join(pages.select("url", F.substring("body", 1, 200).alias("head")).filter(F.col("head").contains("<")), "url")
    return sites.select("base").distinct().join(found.groupBy("base").agg(F.min_by("url", "n").alias("sitemap")), "base", "left")


def listing_types(base: Column, body: Column) -> Column:
    """The (slug, rest_base, endpoint) of the types of a REST index that list events; answers that are no such object give none."""
    types = F.map_entries(F.from_json(body, "map<string,struct<rest_base:string>>"))
    known = F.filter(types, lambda e: e["key"].isin(LISTING_TYPES))

    def shaped(e: Column) -> Column:
        rest = F.coalesce(F.nullif(e["value"]["rest_base"], F.lit("")), e["key"])
        return F.struct(e["key"].alias("slug"), rest.alias("rest_base"), F.concat(root(base), F.lit("/wp-json/wp/v2/"), rest).alias("endpoint"))

    return F.coalesce(F.transform(known, shaped), F.expr("cast(array() as array<struct<slug:string,rest_base:string,endpoint:string>>)"))


LINKS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("href", T.StringType())]))


@F.pandas_udf(LINKS)
def links(bases: pd.Series, pages: pd.Series) -> pd.Series:
    """The links of each page with their texts, resolved against its base, in page order."""
    def one(base, page):
        return [{"text": n.text(), "href": urljoin(base or "", n.attrs["href"])} for n in markup.tree(page or "").below() if n.tag == "a" and "href" in n.attrs]

    return pd.Series([one(*x) for x in zip(bases, pages, strict=True)])


def host(url: Column) -> Column:
    """The host without "www."."""
    return F.replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("www."), F.lit(""))


def nav_links(base: Column, page: Column) -> Column:
    """Links labelled as a listing, without the page itself and repeats: those on the page's host first."""
    bare = lambda u: F.rtrim(u, F.lit("/"))
    labelled = F.filter(links(base, page), lambda a: a["text"].rlike(NAV_LABEL) & (bare(a["href"]) != bare(base)))
    hrefs = F.array_distinct(F.transform(labelled, lambda a: a["href"]))
    near = lambda u: F.contains(host(u), host(base))
    return F.concat(F.filter(hrefs, near), F.filter(hrefs, lambda u: ~near(u)))


def is_bare_home(url: Column) -> Column:
    """Whether a url is a site's front page."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.trim(path, F.lit("/")).isin("", "index.php", "index.html")


def usable(url: Column, final_url: Column, status: Column, body: Column, least: int = 800) -> Column:
    """A page that answered, is no stub, and is on the host that was asked."""
    return F.coalesce((status == 200) & (F.length(body) > least) & F.contains(host(final_url), host(url)), F.lit(False))


def resolved(venues: DataFrame, answers: DataFrame) -> DataFrame:
    """(``id``, ``whats_on_url``): of each venue's candidates the first usable one, where it led to; null without any. ``answers``: url, final_url, status, body."""
    tried = venues.select("id", F.posexplode(patches.candidates(F.col("whats_on_url"), F.col("url_candidates"))).alias("n", "url"))
    good = tried.join(answers, "url").filter(usable(F.col("url"), F.col("final_url"), F.col("status"), F.col("body")))
    led = F.when(F.rtrim("final_url", F.lit("/")) != F.rtrim("url", F.lit("/")), F.col("final_url")).otherwise(F.col("url"))
    return venues.select("id").join(good.groupBy("id").agg(F.min_by(led, "n").alias("whats_on_url")), "id", "left")


#: How pages of bot walls begin, and the least length of a page that was let through.
CHALLENGE = r"(?i)just a moment|checking (?:if )?your (?:connection|browser)|enable javascript and cookies|attention required|cf-browser-verification|verify you are human|connectyourdomain"


def is_challenge(page: Column) -> Column:
    """Whether a rendered page is still a bot wall."""
    return (F.length(page) < 800) | F.substring(page, 1, 4000).rlike(CHALLENGE)


#: Marks of ticketing and web platforms in a page's markup.
PLATFORMS = {
    "spektrix": r"spektrix\.com|spektrix\.js|SpektrixSecure",
    "ticketsolve": r"ticketsolve\.com",
    "ticketsource": r"ticketsource\.co\.uk|ticketsource\.com",
    "eventbrite": r"eventbrite\.co\.uk|eventbrite\.com",
    "seetickets": r"seetickets\.com",
    "ticketco": r"ticketco\.events",
    "tickettailor": r"tickettailor\.com",
    "citizenticket": r"citizenticket\.co\.uk",
    "line-up": r"lineupnow\.com|line-up\.io",
    "wordpress": r"/wp-content/|/wp-json/",
    "squarespace": r"squarespace\.com|static1\.squarespace",
    "nextjs": r"__NEXT_DATA__|/_next/static",
    "nuxt": r"__NUXT__",
    "react-root": r'<div id="root"></div>|<div id="__next"></div>',
    "sanity": r"cdn\.sanity\.io|sanity\.io",
}
TICKETING = ("spektrix", "ticketsolve", "ticketsource", "tickettailor")
#: Class names of frames, and of what may wrap a show.
NAV_CLASS = r"(?i)nav|menu|footer|header|dropdown|social|search|cookie|skip"
EVENT_CLASS = r"(?i)event|show|performance|production|listing|whats-on|card|summary-item|collection-item|programme|calendar"
THIN = 1500


def platforms(page: Column) -> Column:
    """The platforms that a page's markup names, in the order of ``PLATFORMS``."""
    return F.array_compact(F.array(*[F.when(page.rlike(f"(?i){p}"), F.lit(name)) for name, p in PLATFORMS.items()]))


def sanity_project(page: Column) -> Column:
    """The id of the content project whose files a page shows, or null."""
    return F.nullif(F.regexp_extract(page, r"(?i)cdn\.sanity\.io/(?:images|files)/([a-z0-9]+)/", 1), F.lit(""))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("tag", T.StringType()), T.StructField("depth", T.IntegerType()), T.StructField("signature", T.StringType()), T.StructField("href", T.StringType()), T.StructField("rel", T.StringType()), T.StructField("type", T.StringType()), T.StructField("text", T.StringType())])))
def outline_nodes(pages: pd.Series) -> pd.Series:
    """The elements of each page, in page order: depth, class names sorted and joined by dots, some attributes, and the text of those without elements inside."""
    def one(page):
        root = markup.tree(page or "")
        depth, out = {id(root): 0}, []
        for n in root.below():
            depth[id(n)] = depth[id(n.parent)] + 1
            leaf = not any(isinstance(x, markup.Node) for x in n.inside)
            out.append({"tag": n.tag, "depth": depth[id(n)], "signature": ".".join(sorted(n.attrs.get("class", "").split())), "href": n.attrs.get("href"), "rel": n.attrs.get("rel"), "type": n.attrs.get("type"), "text": n.text()[:70] if leaf else None})
        return out

    return pages.map(one)


def _counted(nodes: DataFrame, by: str, tags: tuple[str, ...], low: int, high: int) -> DataFrame:
    """(``by``, ``signature``, ``n``) of class signatures of up to 120 characters that ``tags`` carry ``low`` to ``high`` times."""
    rows = nodes.filter(F.col("node.tag").isin(*tags) & F.length("node.signature").between(1, 120))
    return rows.groupBy(by, F.col("node.signature").alias("signature")).agg(F.count("*").alias("n")).filter(F.col("n").between(low, high))


def candidate_cards(pages: DataFrame, by: str, body: str, most: int = 8) -> DataFrame:
    """(``by``, ``signature``, ``n``, ``place``): the class signatures that repeat like a list of shows."""
    nodes = pages.select(by, F.explode(outline_nodes(body)).alias("node"))
    order = Window.partitionBy(by).orderBy(F.desc("n"), "signature")
    return _counted(nodes, by, ("article", "li", "div", "a"), 3, 60).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def suggested_cards(pages: DataFrame, by: str, body: str, most: int = 25) -> DataFrame:
    """As ``candidate_cards``, of 2 to 80 and sections too, without frames; ``eventish`` names come first."""
    nodes = pages.select(by, F.explode(outline_nodes(body)).alias("node"))
    rows = _counted(nodes, by, ("article", "li", "div", "a", "section"), 2, 80).filter(~F.col("signature").rlike(NAV_CLASS))
    rows = rows.withColumn("eventish", F.col("signature").rlike(EVENT_CLASS))
    order = Window.partitionBy(by).orderBy(F.desc("eventish"), F.desc("n"), "signature")
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def outline(pages: DataFrame, by: str, body: str, depth: int = 4) -> DataFrame:
    """A row for each element of up to ``depth``: place, depth, label (tag and classes), link and text."""
    nodes = pages.select(by, F.posexplode(outline_nodes(body)).alias("pos", "node")).filter(F.col("node.depth") <= depth)
    label = F.concat("node.tag", F.when(F.col("node.signature") != "", F.concat(F.lit("."), "node.signature")).otherwise(""))
    return nodes.select(by, "pos", "node.depth", label.alias("label"), F.substring("node.href", 1, 60).alias("href"), "node.text")


def feeds(page: Column) -> Column:
    """The (unresolved) addresses of the feeds that a page links."""
    fits = F.filter(outline_nodes(page), lambda n: (n["tag"] == "link") & F.coalesce(F.array_contains(F.split(n["rel"], r"\s+"), "alternate"), F.lit(False)) & F.coalesce(F.lower(n["type"]).rlike("rss|atom|xml"), F.lit(False)))
    return F.transform(fits, lambda n: F.coalesce(n["href"], F.lit("")))


def visible_length(page: Column) -> Column:
    """Length of a page's text without scripts, styles and markup."""
    bare = F.regexp_replace(page, r"(?is)<(?:script|style|noscript)\b.*?</(?:script|style|noscript)>|<!--.*?-->|<[^>]*>", " ")
    return F.length(F.trim(F.regexp_replace(bare, r"\s+", " ")))


def probe(venues: DataFrame, pages: DataFrame, types: DataFrame, maps: DataFrame) -> DataFrame:
    """One row a venue: what its page tells, and the strategy and tier that follow from it.

    ``pages``: url, final_url, status, body; ``types``: base, body of a REST index; ``maps``: base, sitemap (``sitemaps``).
    """
    rows = venues.select("id", F.col("whats_on_url").alias("url")).join(pages, "url", "left")
    cards = candidate_cards(pages, "url", "body").groupBy("url").agg(F.array_sort(F.collect_list(F.struct("place", "signature", "n"))).alias("cards"))
    rows = rows.join(cards, "url", "left").join(types.select(F.col("base").alias("final_url"), listing_types(F.col("base"), F.col("body")).alias("_types")), "final_url", "left").join(maps.withColumnRenamed("base", "final_url"), "final_url", "left")
    rows = linked.with_objects(rows, "body").withColumn("_e", linked.events(F.col("_nodes")))
    error = F.when(F.coalesce("url", F.lit("")) == "", "no whats_on_url").when(F.col("body").isNull(), "not fetched")
    told = rows.select(
        "id", "url", error.alias("error"), "status", "final_url", F.length("body").alias("html_bytes"), F.coalesce("_blocks", F.lit(0)).alias("jsonld_blocks"), F.coalesce(F.size("_e"), F.lit(0)).alias("jsonld_events"),
        linked.type_counts(F.col("_nodes")).alias("jsonld_types"), F.coalesce(F.array_contains(F.get("_e", 0)["keys"], "url"), F.lit(False)).alias("jsonld_has_url"), feeds(F.col("body")).alias("feeds"),
        platforms(F.col("body")).alias("platforms"), visible_length(F.col("body")).alias("text_len"), "cards", "sitemap", sanity_project(F.col("body")).alias("sanity_project"), "_types",
    )
    rest = F.when(F.array_contains("platforms", "wordpress"), F.col("_types"))
    told = told.withColumns({"wp_rest": rest, "js_rendered_suspect": F.col("text_len") < THIN}).drop("_types")
    return told.withColumns({"recommended_strategy": recommended_strategy(), "recommended_tier": recommended_tier()})


def _some(name: str) -> Column:
    return F.coalesce(F.size(name), F.lit(0)) > 0


def recommended_strategy() -> Column:
    """The strategy that the signals of ``probe`` recommend. Linked data come first only if they link each event; a seller of tickets is no listing."""
    linked_events, thin = F.col("jsonld_events") > 0, F.coalesce("js_rendered_suspect", F.lit(False))
    return (
        F.when(F.col("error").isNotNull() | (F.coalesce("url", F.lit("")) == ""), "skip")
        .when(F.coalesce("sanity_project", F.lit("")) != "", "sanity")
        .when(linked_events & F.col("jsonld_has_url"), "jsonld")
        .when(_some("cards"), "selectors")
        .when(linked_events, "jsonld")
        .when(_some("wp_rest"), "wp_rest")
        .when(thin, "skip")
        .otherwise("selectors")
    )


def recommended_tier() -> Column:
    """How much work a venue is likely to be."""
    sold = F.coalesce(F.arrays_overlap("platforms", F.array(*[F.lit(p) for p in TICKETING])), F.lit(False))
    fed = _some("feeds") | F.col("sitemap").isNotNull() | _some("wp_rest")
    return (
        F.when(F.col("error").isNotNull(), "skip")
        .when(F.col("jsonld_events") > 0, "1_jsonld")
        .when(F.coalesce("sanity_project", F.lit("")) != "", "2_cms")
        .when(sold, "2_platform")
        .when(~fed & F.col("js_rendered_suspect"), "4_bespoke_or_search")
        .otherwise("3_feed_or_selectors")
    )


def score(rows: DataFrame, listings: Column, *by: str) -> DataFrame:
    """Counts of extracted rows for each attempt ``by``: all, dated, with a link of their own, described, tagged, and useful (titled, dated and linked)."""
    bare = lambda u: F.rtrim(F.coalesce(u, F.lit("")), F.lit("/"))
    own = bare(F.col("url")) != bare(listings)
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.count("first_date").alias("dated"), F.count_if(own & (bare(F.col("url")) != "")).alias("own_url"),
        F.count_if(F.coalesce("description", F.lit("")) != "").alias("desc"), F.count_if(F.coalesce(F.size("venue_tags"), F.lit(0)) > 0).alias("tags"),
        F.count_if((F.coalesce("title", F.lit("")) != "") & F.col("first_date").isNotNull() & own).alias("useful"),
    )


def best_attempt(scored: DataFrame, by: str, attempt: str) -> DataFrame:
    """(``by``, ``best``): the attempt with the most useful, then dated, then all rows; the first name of equals."""
    order = Window.partitionBy(by).orderBy(F.desc("useful"), F.desc("dated"), F.desc("n"), attempt)
    return scored.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select(by, F.col(attempt).alias("best"))
