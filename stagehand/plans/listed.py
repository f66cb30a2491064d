"""Queries of the listing strategies and of show pages: customers are venues, and their orders the shows that pages made of them list."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagehand.plans.catalogue import query
from stagehand.session import table
from stagehand.sources import details, listings

SHOWS = "o AS (SELECT *, o_custkey::VARCHAR AS venue_id, 'http://venue/' || o_custkey AS site, 'Show ' || o_orderkey AS title, (o_orderdate::DATE + INTERVAL 30 YEAR)::DATE AS f, (o_orderdate::DATE + INTERVAL 30 YEAR)::DATE + (o_orderkey % 40)::INTEGER AS l FROM orders)"


def _as_of() -> Column:
    return F.lit(datetime.date(2026, 9, 7))


def _shows(spark, d) -> DataFrame:
    f = F.add_months(F.to_date("o_orderdate"), 360)
    site = F.concat(F.lit("http://venue/"), F.col("o_custkey").cast("string"))
    rows = table(spark, d, "orders").withColumns({"f": f, "l": F.date_add(f, (F.col("o_orderkey") % 40).cast("int")), "site": site})
    return rows.withColumn("title", F.concat(F.lit("Show "), F.col("o_orderkey").cast("string")))


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _day(c: Column | str) -> Column:
    return F.date_format(c, "d MMM yyyy")


def _venues(spark, shows: DataFrame, strategy: str, **settings) -> DataFrame:
    """A venue for each customer, with the settings that its strategy needs."""
    empty = spark.createDataFrame([], listings.VENUE).schema
    known = {"id": F.col("o_custkey").cast("string"), "whats_on_url": F.col("site"), "strategy": F.lit(strategy)} | settings
    return shows.select("o_custkey", "site").distinct().select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in empty])


def _joined(shows: DataFrame, piece: Column, between: str, url: Column | str = "site") -> DataFrame:
    """(url, body): each venue's pieces in the order of their keys."""
    pieces = shows.select(F.col(url).alias("url") if isinstance(url, str) else url.alias("url"), F.struct("o_orderkey", piece.alias("piece")).alias("p"))
    return pieces.groupBy("url").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["piece"]), between).alias("body"))


@query(f"""WITH {SHOWS} SELECT venue_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) - 1 AS pos, title, CASE WHEN o_orderstatus = 'O' THEN site ELSE site || '/' || o_orderkey END AS url, f AS first_date, CASE WHEN o_orderstatus = 'F' THEN f ELSE l END AS last_date, o_orderpriority AS description FROM o""")
def listings_jsonld(spark, d):
    """Events of linked data; of several in a list the last comes first."""
    shows = _shows(spark, d)
    iso = lambda c: F.concat(F.date_format(c, "yyyy-MM-dd"), F.lit("T19:30:00"))
    event = F.struct(
        F.lit("MusicEvent").alias("@type"), F.col("title").alias("name"), F.when(F.col("o_orderstatus") != "O", _text(F.col("site"), "/", F.col("o_orderkey"))).alias("url"),
        iso("f").alias("startDate"), F.when(F.col("o_orderstatus") != "F", iso("l")).alias("endDate"), F.col("o_orderpriority").alias("description"),
    )
    pages = _joined(shows, F.to_json(event), ",").withColumn("body", _text('<script type="application/ld+json">{"@type": "WebSite", "@graph": [', F.col("body"), "]}</script>"))
    return listings.jsonld(_venues(spark, shows, "jsonld"), pages, _as_of()).select("venue_id", F.col("pos").cast("long").alias("pos"), "title", "url", "first_date", "last_date", "description")


@query(f"""WITH {SHOWS} SELECT venue_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, title, o_clerk AS credits, site || '/' || o_orderkey AS url, f AS first_date, l AS last_date, 'A & B of ' || o_orderkey AS description FROM (SELECT *, 'Co ' || o_orderstatus AS o_clerk FROM o)""")
def listings_rest(spark, d):
    """Items of a REST collection, their range of dates written out in a field that the venue names."""
    shows = _shows(spark, d)
    item = F.struct(
        F.struct(F.col("title").alias("rendered")).alias("title"), F.concat(F.lit("Co "), "o_orderstatus").alias("producer"), _text(F.col("site"), "/", F.col("o_orderkey")).alias("link"), _text(_day("f"), " - ", _day("l")).alias("when"),
        F.struct(_text("<p>A &amp;amp; B <b>of</b>\n ", F.col("o_orderkey"), "</p>").alias("rendered")).alias("excerpt"),
    )
    venues = _venues(spark, shows, "wp_rest", endpoint=_text(F.col("site"), "/api"), dates_field=F.lit("when"))
    pages = _joined(shows, F.to_json(item), ",").select(_text(F.col("url"), "/api").alias("url"), _text("[", F.col("body"), "]").alias("body"))
    return listings.wp_rest(venues, pages, _as_of()).select("venue_id", F.col("pos").cast("long").alias("pos"), "title", "credits", "url", "first_date", "last_date", "description")


@query(f"""WITH {SHOWS} SELECT venue_id, title, site || '/show/' || o_orderkey AS url, f AS first_date, CASE WHEN o_orderstatus = 'F' THEN f ELSE l END AS last_date, CASE WHEN o_orderstatus <> 'P' THEN 'About ' || title END AS description FROM o""")
def listings_api(spark, d):
    """Results of a content API; a stub of a description is left out."""
    shows = _shows(spark, d)
    said = F.when(F.col("o_orderstatus") == "P", _text(F.col("title"), " at the Yard Theatre.")).otherwise(_text("About ", F.col("title")))
    item = F.struct("title", said.alias("description"), F.col("o_orderkey").cast("string").alias("slug"), F.struct(F.date_format("f", "yyyy-MM-dd'T'10:00").alias("start"), F.when(F.col("o_orderstatus") != "F", F.date_format("l", "yyyy-MM-dd")).alias("end")).alias("duration"))
    venues = _venues(spark, shows, "sanity", endpoint=_text(F.col("site"), "/q"), show_url_pattern=_text(F.col("site"), "/show/{slug}"))
    pages = _joined(shows, F.to_json(item), ",").select(_text(F.col("url"), "/q").alias("url"), _text('{"result": [', F.col("body"), "]}").alias("body"))
    return listings.sanity(venues, pages, _as_of()).select("venue_id", "title", "url", "first_date", "last_date", "description")


@query(f"""WITH {SHOWS} SELECT venue_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, title, 'Room ' || o_orderstatus AS space, CASE WHEN o_orderstatus = 'O' THEN site ELSE 'http://venue/s/' || o_orderkey END AS url, f AS first_date, l AS last_date, 'Copy of ' || o_orderkey AS description, o_orderpriority AS tag FROM o
QUALIFY o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW'""")
def listings_cards(spark, d):
    """Cards by selectors: rooms that are let in, titles that are left out, links of the card or of its script, blurbs without their marks."""
    shows = _shows(spark, d)
    link = F.when(F.col("o_orderstatus") == "O", F.lit("<a href='#'>x</a>")).when(F.col("o_orderkey") % 2 == 0, _text("<a href='/s/", F.col("o_orderkey"), "'>more</a>")).otherwise(F.lit(""))
    script = F.when((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 2 == 1), _text(" onclick=\"goToUrl('/s/", F.col("o_orderkey"), "')\"")).otherwise(F.lit(""))
    card = _text(
        "<div class='big card'", script, "><h3>", F.col("title"), F.when(F.col("o_orderpriority") == "5-LOW", " (Hire)").otherwise(" Mon 7pm"), "</h3><p>in <i>Room ", F.col("o_orderstatus"), "</i></p>", link,
        "<time>", _day("f"), " to ", _day("l"), "</time><div class=b>Copy <em>(new)</em> of ", F.col("o_orderkey"), "</div><ul><li>", F.col("o_orderpriority"), "</li><li>", F.col("o_orderpriority"), "</li></ul></div>",
    )
    by = {"show_card": "div.card.big", "title": "h3", "space": "p > i", "dates": "time", "blurb": ".b", "blurb_strip": "em", "tags": "li", "title_cut_dates": "true"}
    venues = _venues(spark, shows, "selectors", selectors=F.create_map(*[F.lit(x) for kv in by.items() for x in kv]), exclude=F.array(F.lit("(hire)")), space_allow=F.array(F.lit("room o"), F.lit("room f")))
    rows = listings.selectors(venues, _joined(shows, card, "\n"), _as_of())
    return rows.select("venue_id", F.col("pos").cast("long").alias("pos"), "title", "space", "url", "first_date", "last_date", "description", F.array_join("venue_tags", ",").alias("tag"))


@query(f"""WITH {SHOWS} SELECT venue_id, title, 'http://venue/show-' || o_orderkey AS url, f AS first_date, l AS last_date FROM o""")
def listings_clusters(spark, d):
    """Short dated texts with the last title before them, on pages without cards."""
    shows = _shows(spark, d)
    piece = _text("<div><h3>", F.col("title"), "</h3><a href='/show-", F.col("o_orderkey"), "'>more</a><p>", F.repeat(F.lit("words "), 20), "</p></div><div><span>", _day("f"), " - ", _day("l"), "</span></div>")
    pages = _joined(shows, piece, "").withColumn("body", _text("<body><h1>What's on</h1><div>", F.col("body"), "</div>"))
    return details.dated_clusters(_venues(spark, shows, "dated_clusters"), pages, _as_of()).select("venue_id", "title", "url", "first_date", "last_date")


@query(f"""WITH {SHOWS} SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN venue_id ELSE 'home' END AS venue_id, title, CASE WHEN o_orderstatus = 'P' THEN site ELSE 'https://tickets.example/' || o_orderkey END AS url,
 CASE o_orderstatus WHEN 'O' THEN DATE '2026-09-07' ELSE f END AS first_date, CASE o_orderstatus WHEN 'O' THEN DATE '2026-09-07' + 400 WHEN 'F' THEN f + 400 ELSE l END AS last_date, 'What ' || o_orderkey || ' is.' || chr(10) || chr(10) || 'go' AS description FROM o WHERE o_orderpriority <> '5-LOW'""")
def listings_sections(spark, d):
    """Shows under section headings: those outside the city go, those at home have a venue of their own, open runs end in 400 days."""
    from stagehand.sources.sections import sections

    shows = _shows(spark, d)
    kind = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 0).when(F.col("o_orderpriority") == "5-LOW", 2).otherwise(1)
    said = F.when(F.col("o_orderstatus") == "O", F.lit("Ongoing")).when(F.col("o_orderstatus") == "F", _text("From ", _day("f"))).otherwise(_text(_day("f"), " - ", _day("l")))
    link = F.when(F.col("o_orderstatus") == "P", F.lit("https://wix.com/x")).otherwise(_text("https://tickets.example/", F.col("o_orderkey")))
    strip = _text("<section class='a-column-strip'><h2>", F.col("title"), "</h2><p>What ", F.col("o_orderkey"), " is.</p><p>Jump to tickets</p><p>\U0001f4cd Here</p><p>\U0001f552 ", said, "</p><a href='", link, "'>go</a></section>")
    heads = F.array(F.lit("<h6>Immersive/Interactive</h6>"), F.lit("<h6>AT HOME</h6>"), F.lit("<h6>Outside of London</h6>"))
    parts = _joined(shows.withColumn("part", _text(F.col("site"), " ", kind)), strip, "", "part").select(F.split("url", " ").alias("u"), "body")
    ordered = parts.select(F.get("u", 0).alias("url"), F.struct(F.get("u", 1).cast("int").alias("k"), "body").alias("p")).groupBy("url").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    pages = ordered.select("url", F.array_join(F.transform("ps", lambda p: F.concat(F.get(heads, p["k"]), p["body"])), "").alias("body"))
    return sections(_venues(spark, shows, "immersive_rumours"), pages, _as_of()).select("venue_id", "title", "url", "first_date", "last_date", "description")


def _with_pages(shows: DataFrame) -> DataFrame:
    """Shows with the ``body`` of their own page, and the selector of its dates in ``by``."""
    a = _text("The first long paragraph of ", F.col("title"), " tells what happens on the stage that night.")
    b = _text("The second paragraph goes on about number ", F.col("o_orderkey"), " for a while and then ends.")
    longer = _text(a, " It is told in full here, and then told once more so that the copy of the linked data is longer than that of the page, which has two paragraphs and would be taken otherwise; and so it goes on, night after night, until all have heard it.")
    event = F.struct(F.lit("Event").alias("@type"), F.date_format("f", "yyyy-MM-dd").alias("startDate"), F.date_format("l", "yyyy-MM-dd").alias("endDate"), longer.alias("description"), F.struct(F.lit("9.50").alias("price")).alias("offers"))
    linked = F.when(F.col("o_orderstatus") == "F", _text('<script type="application/ld+json">', F.to_json(event), "</script>")).otherwise(F.lit(""))
    stamp = lambda c: _text("<time datetime='", F.date_format(c, "yyyy-MM-dd"), "T19:00'>then</time>")
    dated = F.when(F.col("o_orderstatus") == "O", _text(stamp("f"), stamp("l"))).when(F.col("o_orderstatus") == "P", stamp("l")).otherwise(F.lit("1 May 2020"))
    head = F.when(F.col("o_orderkey") % 2 == 0, _text("<meta property='og:title' content='", F.col("title"), " | House'>")).otherwise(_text("<meta property='og:title' content='", F.col("title"), " and ...'>"))
    body = _text("<head>", head, linked, "</head><body><h1>", F.col("title"), " – House</h1><article><p>", a, "</p><p>Book now</p><p>", b, "</p></article><div class=d>", dated, "</div><p>Tickets £12.50 or £", F.format_string("%.2f", "o_totalprice"), "</p>")
    return shows.withColumns({"body": body, "by": F.lit(".d")})


@query(f"""WITH {SHOWS}, t AS (SELECT *, 'The first long paragraph of ' || title || ' tells what happens on the stage that night.' AS a, 'The second paragraph goes on about number ' || o_orderkey || ' for a while and then ends.' AS b FROM o)
SELECT o_orderkey, title AS full_title, CASE WHEN o_orderstatus = 'F' THEN a || ' It is told in full here, and then told once more so that the copy of the linked data is longer than that of the page, which has two paragraphs and would be taken otherwise; and so it goes on, night after night, until all have heard it.' ELSE a || chr(10) || chr(10) || b END AS description, CASE WHEN o_orderstatus = 'P' THEN l ELSE f END AS first_date, l AS last_date,
 CASE WHEN o_orderstatus = 'F' THEN 9.5 ELSE least(12.5, o_totalprice::DECIMAL(12, 2)::DOUBLE) END AS price_min, CASE WHEN o_orderstatus <> 'F' THEN greatest(12.5, o_totalprice::DECIMAL(12, 2)::DOUBLE) END AS price_max FROM t""")
def show_pages(spark, d):
    """What shows' own pages tell: titles without the site's name, copy, dates of stamped elements, linked data or texts, prices."""
    shows = _shows(spark, d).repartition("o_orderkey")  # short rows are dealt out before they become pages, as a file may be one split
    told = details.facts_of(_with_pages(shows), _as_of(), "title", "by")
    return told.select("o_orderkey", "d.full_title", "d.description", "d.first_date", "d.last_date", "d.price_min", "d.price_max")


@query(f"""WITH {SHOWS}, t AS (SELECT *, o_orderstatus = 'F' AS told, 'The first long paragraph of ' || title || ' tells what happens on the stage that night.' AS a, 'The second paragraph goes on about number ' || o_orderkey || ' for a while and then ends.' AS b FROM o)
SELECT venue_id, o_orderkey AS pos, CASE WHEN told THEN title || ' ...' ELSE title END AS title, CASE WHEN told THEN repeat('x', 300) ELSE a || chr(10) || chr(10) || b END AS description, CASE WHEN o_orderstatus = 'P' THEN l ELSE f END AS first_date, l AS last_date,
 CASE WHEN NOT told THEN least(12.5, o_totalprice::DECIMAL(12, 2)::DOUBLE) END AS price_min, CASE WHEN NOT told THEN greatest(12.5, o_totalprice::DECIMAL(12, 2)::DOUBLE) END AS price_max FROM t""")
def folded_pages(spark, d):
    """Listing rows with their own pages folded in; rows with a full copy and dates pass by the pages."""
    shows = _with_pages(_shows(spark, d)).withColumn("told", F.col("o_orderstatus") == "F").withColumn("url", _text(F.col("site"), "/", F.col("o_orderkey")))
    nothing = lambda kind: F.lit(None).cast(kind)
    rows = shows.select(
        F.col("o_custkey").cast("string").alias("venue_id"), F.col("o_orderkey").alias("pos"), _text(F.col("title"), " ...").alias("title"), "url", F.when(F.col("told"), F.repeat(F.lit("x"), 300)).alias("description"),
        F.when(F.col("told"), F.col("f")).alias("first_date"), F.when(F.col("told"), F.col("l")).alias("last_date"), nothing("double").alias("price_min"), nothing("double").alias("price_max"),
    )
    venues = _venues(spark, shows, "selectors", detail_dates=F.lit(".d"))
    return details.hop(rows, venues, shows.select("url", "body"), _as_of()).drop("url")
