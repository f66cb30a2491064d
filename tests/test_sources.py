import datetime
import json

import pytest
from pyspark.sql import functions as F

from stagehand.functions import markup, text
from stagehand.sources import listings, sinks
from stagehand.streaming import events

D = datetime.date
AS_OF = D(2026, 9, 7)
CARDS = """<div class="card big"><h3>Five</h3><span class=room>Studio 1</span><p><time>7 Oct 2026</time></p><a href="#">x</a><a href="/show/5">y</a><div class=b>A <i>(new)</i> tale</div><li>new</li><li>old</li><li>new</li></div>
<div class="card big"><h3>Six</h3><span class=room>Cinema</span></div><div class="card"><h3>Seven</h3></div><div class="big card"><h3>Paris</h3><span class=room>studio</span></div>"""


def test_paragraphs_about_the_booking(spark):
    said = [("Book now for the best seats", True), ("A girl walks into the sea and comes back changed.", False), (None, True), ("  ", True), ("THE WINTER OF IT", True), ("Until 24 Oct Main House", True), ("★★★ fine", True), ("Some Company presents", True), ("“A triumph”", True), ("123", False)]
    rows = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(said)], "i int, s string")
    for r in rows.select("i", text.is_chrome(F.col("s")).alias("x")).collect():
        assert r["x"] == said[r["i"]][1], said[r["i"]]


def test_credits(spark):
    said = [("Written by Ann Lee and directed by Bo Ray.", True), ("By Tuesday the whole street knew.", False), ("Music by Cy Fox. Lyrics by Di Gray.", True), ("", False), (None, False), ("By " + "A b " * 80, False)]
    rows = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(said)], "i int, s string")
    for r in rows.select("i", text.is_credits(F.col("s")).alias("x")).collect():
        assert r["x"] == said[r["i"]][1], said[r["i"]]


def test_listings_of_each_strategy(spark, tmp_path):
    venues = [
        {"id": "a", "whats_on_url": "http://a/on"},
        {"id": "b", "strategy": "wp_rest", "whats_on_url": "http://b/on", "endpoint": "http://b/api", "dates_field": "when"},
        {"id": "c", "strategy": "sanity", "whats_on_url": "http://c/on/", "endpoint": "http://c/api"},
        {"id": "d", "fetch_method": "js_rendered", "whats_on_url": "http://a/on"},
        {"id": "e"},
        {"id": "f", "whats_on_url": "http://f/on", "space_allow": ["studio"], "exclude": ["paris"], "selectors": {"show_card": ".card.big", "title": "h3", "space": ".room", "dates": "p > time", "blurb": ".b", "blurb_strip": "i", "tags": "li", "link": "a[href*='/show/']"}},
    ]
    (tmp_path / "venues.json").write_text(json.dumps(venues))
    tree = {"@graph": [{"@type": "TheaterEvent", "name": "One", "startDate": "2026-10-01T19:00"}, {"@type": ["Event"], "name": "Two", "url": "http://a/2", "startDate": "1 - 3 Nov 2026"}, {"@type": "Place", "name": "x"}, {"@type": "Event", "name": ""}]}
    page = f'<script type="application/ld+json">{json.dumps(tree)}</script><script type="application/ld+json">not json</script>'
    rest = json.dumps([{"title": {"rendered": "Three"}, "producer": "P Co", "link": "http://b/3", "when": "4 - 9 May 2027", "excerpt": {"rendered": "<p>A &amp; B</p>"}}, {"title": {"rendered": ""}}])
    api = json.dumps({"result": [{"title": "Four", "slug": "four", "duration": {"start": "2026-09-10T10:00Z"}, "description": "Four at The Yard Theatre."}, {"slug": "none"}]})
    pages = spark.createDataFrame([("http://a/on", page), ("http://b/api", rest), ("http://c/api", api), ("http://f/on", CARDS)], "url string, body string")
    got = {r["title"]: r for r in listings.extract(listings.registry(spark, str(tmp_path / "venues.json")), pages, F.lit(AS_OF)).collect()}
    assert set(got) == {"One", "Two", "Three", "Four", "Five"}
    assert (got["One"]["url"], got["One"]["first_date"], got["One"]["last_date"]) == ("http://a/on", D(2026, 10, 1), D(2026, 10, 1))
    assert (got["Two"]["url"], got["Two"]["first_date"], got["Two"]["last_date"]) == ("http://a/2", D(2026, 11, 1), D(2026, 11, 3))
    assert (got["Three"]["credits"], got["Three"]["description"], got["Three"]["last_date"]) == ("P Co", "A & B", D(2027, 5, 9))
    assert (got["Four"]["url"], got["Four"]["description"], got["Four"]["last_date"]) == ("http://c/on/four", None, D(2026, 9, 10))


    five = got["Five"]
    assert (five["space"], five["url"], five["first_date"], five["description"], five["venue_tags"]) == ("Studio 1", "http://f/show/5", D(2026, 10, 7), "A tale", ["new", "old"])


def test_selectors():
    root = markup.tree("<div id=x class='a b'><p>1<br>2<p class=b>3</div><img alt=z></i>")
    assert [n.tag for n in markup.select(root, "div.a, img[alt]")] == ["div", "img"]
    assert [n.text() for n in markup.select(root, "#x .b")] == ["3"]
    assert markup.select(root, "img > p") == []
    assert markup.tree("").text() == "" and len(markup.tree("<b>" * 5000).below()) == 5000
    flat = markup.tree("<div><b>1</b><i>2</i><b>3</b></div>")
    assert [n.text() for n in markup.select(flat, "b:last-of-type")] == ["3"] and [n.text() for n in markup.select(flat, "b:nth-of-type(1), b:nth-last-of-type(1)")] == ["1", "3"]
    assert [n.tag for n in markup.select(root, "div:has(.b):not(.c)")] == ["div"] and markup.select(root, "p:not(.b):-soup-contains('9')") == []
    assert markup.select(root, "p:first-child") == []
    with pytest.raises(ValueError):
        markup.compiled("p:first-child")


def test_registry_of_nested_settings(spark, tmp_path):
    yaml = """
venues:
- id: a
  name: The A
  location:
    area: Islington
  whats_on_url: http://f/on
  strategy: selectors
  lookahead_weeks: 12
  detail_selectors:
    dates: ".d"
  selectors:
    show_card: ".card.big"
    title: h3
    space: .room
    space_allow: [Studio]
    exclude: [paris]
    title_cut_dates: true
- id: b
  seasonal: true
  wp_rest:
    endpoint: http://b/api
    dates_field: when
- id: c
  sanity:
    project_id: p1
"""
    (tmp_path / "venues.yaml").write_text(yaml)
    venues = listings.registry(spark, str(tmp_path / "venues.yaml"))
    got = {r["id"]: r for r in venues.collect()}
    assert (got["a"]["area"], got["a"]["space_allow"], got["a"]["exclude"], got["a"]["detail_dates"]) == ("Islington", ["Studio"], ["paris"], ".d")
    assert got["a"]["selectors"]["title_cut_dates"] == "true" and got["b"]["endpoint"] == "http://b/api?per_page=50"
    assert got["c"]["endpoint"].startswith("https://p1.api.sanity.io/v2021-10-21/data/query/production?query=") and got["b"]["seasonal"]
    pages = spark.createDataFrame([("http://f/on", CARDS)], "url string, body string")
    assert [r["title"] for r in listings.selectors(venues, pages, F.lit(AS_OF)).collect()] == ["Five"]


def test_sections_and_seed(spark):
    strip = lambda title, place, dates, link: f"<section class='wixui-column-strip'><h2>{title}</h2><p>What {title} is.</p><p>Jump to tickets</p><p>📍 {place}</p><p>🕒 {dates}</p><p>🎟️ Book via <a href='{link}'>x</a></p></section>"
    page = "<h6>Immersive/Interactive Shows</h6>" + strip("One", "Battersea", "Until 13th September 2026", "https://one.com") + strip("Two", "Park", "From 3 May 2027", "https://wix.com/x")
    page += "<h6>AT HOME</h6>" + strip("Three", "Anywhere", "Ongoing", "https://three.com") + "<h6>Outside of London</h6>" + strip("Four", "York", "Ongoing", "https://four.com") + "<h6>Coming soon</h6>" + strip("Five", "WhatsApp", "Late summer 2027", "https://five.com") + "<h2>No strip</h2>"
    venues = spark.createDataFrame([("v", "http://v/on")], "id string, whats_on_url string")
    got = {r["title"]: r for r in listings.sections(venues, spark.createDataFrame([("http://v/on", page)], "url string, body string"), F.lit(AS_OF)).collect()}
    assert set(got) == {"One", "Two", "Three", "Five"}
    run = lambda t: (got[t]["first_date"], got[t]["last_date"])
    assert run("One") == (AS_OF, D(2026, 9, 13)) and run("Two") == (D(2027, 5, 3), D(2027, 5, 3) + datetime.timedelta(400))
    assert run("Three") == (AS_OF, AS_OF + datetime.timedelta(400)) and run("Five") == (D(2027, 8, 1), D(2027, 9, 30))
    assert [got[t]["venue_id"] for t in ("One", "Three", "Five")] == ["v", "home", "home"]
    assert (got["One"]["url"], got["Two"]["url"], got["One"]["description"]) == ("https://one.com", "http://v/on", "What One is.\n\nx")
    rows = listings.seed(spark, {"a": {"base": "http://a/", "shows": [("T", None, None, "2026-10-01", "2026-10-02", "t", ["Comedy"], "Copy"), ("U", None, None, "2026-10-01", "2026-10-02", None, [], None)]}, "b": {"base": "http://b/", "trailing_slash": False, "shows": [("V", None, None, "2026-10-01", "bad", "v", [], None)]}})
    assert {r["title"]: (r["url"], r["last_date"]) for r in rows.collect()} == {"T": ("http://a/t/", D(2026, 10, 2)), "U": ("http://a/", D(2026, 10, 2)), "V": ("http://b/v", None)}


def test_unknown_strategy_is_an_error(spark):
    venues = spark.createDataFrame([("a", "magic")], "id string, strategy string").selectExpr(*[f"cast({f.name if f.name in ('id', 'strategy') else 'null'} as {f.dataType.simpleString()}) as {f.name}" for f in spark.createDataFrame([], listings.VENUE).schema])
    with pytest.raises(Exception, match="unknown strategy"):
        listings.extract(venues, spark.createDataFrame([], "url string, body string"), F.lit(AS_OF)).collect()


def test_dump_and_guarded_snapshots(spark, tmp_path):
    (tmp_path / "raw.json").write_text(json.dumps({"events": [{"venue_id": "a", "title": "T", "first_date": "2026-10-01"}, {"venue_id": "b", "title": "U", "first_date": "bad"}]}))
    rows = listings.dump(spark, str(tmp_path / "raw.json"))
    assert [(r["pos"], r["first_date"], r["last_date"]) for r in rows.orderBy("pos").collect()] == [(0, D(2026, 10, 1), None), (1, None, None)]
    out = str(tmp_path / "snaps")
    assert sinks.before(spark, out, "2026-01-01") is None
    sinks.guarded_save(rows, out, "2026-01-01", "venue_id")
    with pytest.raises(sinks.Refused):
        sinks.guarded_save(rows.filter("venue_id = 'a'"), out, "2026-01-08", "venue_id")
    sinks.guarded_save(rows.filter("venue_id = 'a'"), out, "2026-01-08", "venue_id", force=True)
    assert sinks.before(spark, out, "2026-01-09").count() == 1


def test_artifact(spark):
    shows = spark.createDataFrame([("b", "Y"), ("a", "X")], "venue_id string, title string")
    venues = spark.createDataFrame([("a", "The A", None)], "id string, name string, area string")
    page = sinks.artifact(shows, venues, "<script>var e = /*__EVENTS__*/[];</script>", ["title"]).first()["page"]
    got = json.loads(page.removeprefix("<script>var e = ").removesuffix(";</script>"))
    assert [(e["id"], e["title"], e["venue_name"], e["venue_area"]) for e in got] == [("e000", "X", "The A", ""), ("e001", "Y", "b", "")]
    assert json.loads(sinks.artifact(shows.limit(0), venues, "/*__EVENTS__*/[]", ["title"]).first()["page"]) == []
    with pytest.raises(ValueError):
        sinks.artifact(shows, venues, "nothing", ["title"])


def test_fresh_pages(spark):
    pages = spark.sql("select * from values ('u', 'old', timestamp'2026-09-07 01:00:00'), ('u', 'new', timestamp'2026-09-07 09:00:00'), ('v', 'gone', timestamp'2026-09-01 09:00:00') t(url, body, fetched_at)")
    assert [(r["url"], r["body"]) for r in listings.fresh(pages, F.lit(datetime.datetime(2026, 9, 7, 12)), 12).collect()] == [("u", "new")]


def test_streams_equal_batches(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.sql("select id as event_id, timestamp_ntz'2026-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(id as int)) as ts, if(id % 2 = 0, 'a', 'b') as event_type, id % 3 as user_id, 1.0D as value from range(100)").write.parquet(path)
    batch = spark.read.parquet(path)
    stream = events.read(spark, path, batch.schema)
    q = events.windowed(stream).writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = events.windowed(batch.withColumn("ts", F.col("ts").cast("timestamp")))
    assert sorted(map(tuple, spark.table("counted").collect())) == sorted(map(tuple, want.collect()))
    assert events.sessions(batch.withColumn("ts", F.col("ts").cast("timestamp")), "2 hours").count() == 100
    out, calls = str(tmp_path / "memo"), []

    def judge(new):
        calls.append(1)
        return new.select("user_id", F.lit(True).alias("keep"))

    for _ in range(2):
        events.memoised(events.read(spark, path, batch.schema), "user_id", out, judge, str(tmp_path / "mark")).awaitTermination(120)
        batch.limit(5).withColumn("user_id", F.col("event_id") % 4).write.mode("append").parquet(path)
    assert sorted(r["user_id"] for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3]


def test_lines_keep_their_digits(spark):
    """Trimming takes spaces alone, whatever the line's place."""
    strip = "<section class='column-strip'><h2>Show 10</h2><p>0 Ten times 10</p><p>100</p></section>"
    venues = spark.createDataFrame([("v", "http://v/on")], "id string, whats_on_url string")
    got = listings.sections(venues, spark.createDataFrame([("http://v/on", strip)], "url string, body string"), F.lit(AS_OF)).first()
    assert got["description"] == "0 Ten times 10\n\n100"
    lines = "\n".join(f" {i} a paragraph that is long enough to be kept, number {i} " for i in range(12))
    kept = spark.createDataFrame([(lines,)], "t string").select(text.paragraphs(F.col("t")).alias("p")).first()["p"]
    assert kept == [f"{i} a paragraph that is long enough to be kept, number {i}" for i in range(12)]
