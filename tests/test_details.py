import datetime

from pyspark.sql import functions as F

from stagehand.sources import details, probes

D = datetime.date
AS_OF = D(2026, 9, 7)
LONG = "A keeper on a far island finds letters that were never meant to be read. {}"


def test_synopsis(spark):
    one, two, three = (LONG.format(f"Part {w} of it.") for w in ("one", "two", "three"))
    cases = [
        ("nested", f"<main><p>{one}<p>{two}</p></p></main>", two),
        ("outside", f"<article></article><p>{one}</p>", one),
        ("quoted", f"<article><p><em>{one}</em></p><p>{two}</p></article>", two),
        ("only quoted", f"<blockquote><p>{one}</p></blockquote>", one),
        ("below", f"<p>{one}</p><h3>The  Story</h3><p>{two}</p>", two),
        ("empty below", f"<p>{one}</p><h3>Synopsis</h3><p>Book now</p>", one),
        ("font", f"<div><font>{one}<br></font><font>short</font></div>", one),
        ("many", "".join(f"<p>{x}</p>" for x in (one, one, two, three, one)), "\n\n".join((one, two, three))),
        ("presents", f"<p>Some Company presents {one}</p>", one),
        ("none", "<p>Book now</p>", None),
        ("null", None, None),
    ]
    rows = spark.createDataFrame([(n, p) for n, p, _ in cases], "name string, page string")
    got = {r["name"]: r["s"] for r in rows.select("name", details.synopsis(F.col("page"), F.lit("The Keeper")).alias("s")).collect()}
    assert got == {n: w for n, _, w in cases}


def test_detail_dates(spark):
    rows = spark.createDataFrame(
        [(0, "<div class=d><time datetime='2026-10-01T19:00'>x</time><time datetime='2026-10-09'>y</time><i datetime='soon'></i></div>", ".d"), (1, "<p class=d>4 - 9 May 2027</p>", ".d"), (2, "<p>4 May</p>", ".d"), (3, "<p>4 May</p>", None), (4, None, "p")],
        "i int, page string, selector string",
    )
    got = {r["i"]: tuple(r["w"] or (None, None)) for r in rows.select("i", details.detail_dates(F.col("page"), F.col("selector"), F.lit(AS_OF)).alias("w")).collect()}
    assert got == {0: (D(2026, 10, 1), D(2026, 10, 9)), 1: (D(2027, 5, 4), D(2027, 5, 9)), 2: (None, None), 3: (None, None), 4: (None, None)}


def test_dated_clusters(spark):
    page = """<h1>What's On</h1><div><h3>Moth</h3><a href="/moth">more</a></div><div><span>4 - 9 May 2027</span></div><div><span>4 - 9 May 2027</span></div>
    <div><h4>7pm</h4><div><h4>Owl</h4> 3 Jun 2027</div></div><p>12 Jul 2027</p>"""
    venues = spark.createDataFrame([("v", "http://v/on"), ("w", "http://w/on")], "id string, whats_on_url string")
    pages = spark.createDataFrame([("http://v/on", page), ("http://w/on", None)], "url string, body string")
    got = sorted((r["title"], r["url"], r["first_date"], r["last_date"]) for r in details.dated_clusters(venues, pages, F.lit(AS_OF)).collect())
    assert got[0] == ("Moth", "http://v/moth", D(2027, 5, 4), D(2027, 5, 9))
    assert [(t, s) for t, _, s, _ in got[1:]] == [("Owl", D(2027, 6, 3)), ("Owl", D(2027, 7, 12))]


def test_links_near_titles(spark):
    page = """<body><div class=page><div><h5>We'll Always Have Paris</h5><a href="/on/well-always-have-paris">More</a></div><div>15 Sep - 3 Oct 2026</div>
    <div><h5>Iceberg Right Ahead</h5><a href="mailto:x@y.z">mail</a><a href="/on/iceberg-right-ahead">More</a></div><div>20 Oct - 31 Oct 2026</div></div><h5>Alone Title</h5><p>1 Nov 2026</p></body>"""
    venues = spark.createDataFrame([("v", "http://v/on")], "id string, whats_on_url string")
    got = {r["title"]: r["url"] for r in details.dated_clusters(venues, spark.createDataFrame([("http://v/on", page)], "url string, body string"), F.lit(AS_OF)).collect()}
    assert got == {"We'll Always Have Paris": "http://v/on/well-always-have-paris", "Iceberg Right Ahead": "http://v/on/iceberg-right-ahead"}


def test_hop_folds_pages_in(spark):
    copy = LONG.format("It goes on.")
    page = f"""<head><meta property="og:title" content="Advanced Playwriting with Ann | House"><meta name="description" content="House bio"></head>
    <body><h1>Advanced</h1><article><p>{copy}</p></article><p>Tickets £12.50 or £ 8</p></body>"""
    event = '<script type="application/ld+json">{"@type": "Event", "name": "x", "startDate": "2026-10-01T19:00", "endDate": "2050-01-01", "offers": {"price": "15"}, "description": "%s"}</script>' % copy
    rows = spark.createDataFrame(
        [("v", 0, "Advanced Playwriting ...", "http://v/a/", None, None, "Stub"), ("v", 1, "Event Show", "http://v/b", None, None, None), ("v", 2, "Full", "http://v/c", D(2026, 9, 9), D(2026, 9, 9), "x" * 300), ("v", 3, "Listing", "http://v/on", None, None, None), ("w", 4, "Missing page", "http://w/x", None, None, None)],
        "venue_id string, pos long, title string, url string, first_date date, last_date date, description string",
    ).withColumns({"price_min": F.lit(None).cast("double"), "price_max": F.lit(None).cast("double")})
    venues = spark.createDataFrame([("v", "http://v/on/", None, ".d")], "id string, whats_on_url string, skip_stage2 boolean, detail_dates string")
    pages = spark.createDataFrame([("http://v/a", page), ("http://v/b", event + "<p class=d>4 - 9 May 2027</p>"), ("http://v/c", page)], "url string, body string")
    got = {r["pos"]: r for r in details.hop(rows, venues, pages, F.lit(AS_OF)).collect()}
    assert len(got) == 5
    assert (got[0]["title"], got[0]["description"], got[0]["price_min"], got[0]["price_max"]) == ("Advanced Playwriting with Ann", copy, 8.0, 12.5)
    assert (got[1]["first_date"], got[1]["last_date"], got[1]["price_min"], got[1]["description"]) == (D(2027, 5, 4), D(2027, 5, 9), 15.0, copy)
    assert (got[2]["title"], got[2]["description"]) == ("Full", "x" * 300) and got[3]["description"] is None and got[4]["title"] == "Missing page"


def test_probes(spark):
    sites = spark.createDataFrame([("http://a/x",), ("http://b",)], "base string")
    pages = spark.createDataFrame([("http://a/sitemap_index.xml", "<x>"), ("http://a/wp-sitemap.xml", "<y>"), ("http://a/sitemap.xml", "gone"), ("http://b/sitemap.xml", None)], "url string, body string")
    assert {r["base"]: r["sitemap"] for r in probes.sitemaps(sites, pages).collect()} == {"http://a/x": "http://a/sitemap_index.xml", "http://b": None}
    bodies = spark.createDataFrame([(0, '{"event": {"rest_base": "gigs"}, "show": {}, "post": {"rest_base": "p"}}'), (1, "[1]"), (2, None)], "i int, body string")
    got = {r["i"]: [tuple(x) for x in r["t"]] for r in bodies.select("i", probes.listing_types(F.lit("http://a/x"), F.col("body")).alias("t")).collect()}
    assert got == {0: [("event", "gigs", "http://a/wp-json/wp/v2/gigs"), ("show", "show", "http://a/wp-json/wp/v2/show")], 1: [], 2: []}
    page = "<a href='http://other/e'>Events</a><a href='/on'>What's On</a><a href='/'>Shows</a><a href='/about'>About</a>"
    rows = spark.createDataFrame([("http://www.a/", page), ("http://www.a/", None)], "base string, page string")
    assert [r["n"] for r in rows.select(probes.nav_links("base", "page").alias("n")).collect()] == [["http://www.a/on", "http://other/e"], []]
