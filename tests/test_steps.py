"""The build step, judgements, audits, patches, search, the reader's page and probes."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from stagehand.operators import audits, build, facets, judgement, patches, search
from stagehand.sources import listings, probes, sinks

D = datetime.date
AS_OF = D(2026, 9, 7)
LONG = "A keeper on a far island finds letters that were never meant to be read. {}"
EVENT = "idx int, venue_id string, title string, byline string, description string, first_date date, last_date date, url string, tags array<string>"


def events(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], EVENT)


def show(title, venue="a", byline=None, description=None, tags=("theatre",), first=D(2026, 9, 10), last=D(2026, 12, 10)):
    return venue, title, byline, description, first, last, f"http://{venue}/{title}", list(tags)


@pytest.fixture(scope="module")
def venues(spark):
    rows = [("a", "The A", "Islington", "http://a/on", None), ("b", None, None, "http://b/on", 20)]
    named = spark.createDataFrame(rows, "id string, name string, area string, whats_on_url string, lookahead_weeks int")
    return named.withColumns({"skip_stage2": F.lit(None).cast("boolean"), "detail_dates": F.lit(None).cast("string")})


def listed(spark, rows):
    full = [(v, p, t, None, None, u, f, l, d, tags, "x") for v, p, t, u, f, l, d, tags in rows]
    return spark.createDataFrame(full, "venue_id string, pos long, title string, credits string, space string, url string, first_date date, last_date date, description string, venue_tags array<string>, source string")


def test_crawl_and_build(spark, venues):
    rows = listed(spark, [
        ("a", 0, "One", "http://a/1", D(2026, 9, 10), D(2026, 9, 10), None, []), ("a", 1, "ONE!", "http://a/2", D(2026, 9, 12), D(2026, 9, 12), LONG.format("It is told."), ["Comedy"]),
        ("a", 2, "Same page", "http://a/1/", D(2026, 9, 10), D(2026, 9, 10), None, []), ("a", 3, "Far", "http://a/3", D(2026, 12, 1), D(2026, 12, 1), None, []), ("b", 4, "Later", "http://b/3", D(2026, 12, 1), D(2026, 12, 1), None, []),
        ("a", 5, "!!", "", D(2026, 9, 20), D(2026, 9, 20), None, []), ("a", 6, "??", None, D(2026, 9, 21), D(2026, 9, 21), None, []), ("a", 7, "Undated", "http://a/7", None, None, None, []),
    ])
    pages = spark.createDataFrame([("http://a/7", '<script type="application/ld+json">{"@type": "Event", "startDate": "2027-05-01", "endDate": "2027-05-02"}</script>')], "url string, body string")
    got = {r["title"]: r for r in build.crawl(rows, venues, pages, F.lit(AS_OF)).collect()}
    assert set(got) == {"One", "Later", "!!", "??"}
    one = got["One"]
    assert (one["first_date"], one["last_date"], one["byline"], one["description"]) == (D(2026, 9, 10), D(2026, 9, 12), LONG.format("It is told."), None)
    raw = rows.withColumn("byline", F.lit(None).cast("string"))
    built = build.normalised(raw, AS_OF, D(2026, 11, 1))
    assert [r["title"] for r in build.records(built).collect()] == ["One", "Same page", "ONE!", "!!", "??"]
    assert build.records(built).columns == build.RECORD
    assert {(r["title"], r["reason"]) for r in build.dropped(built).collect()} == {("Far", "outside window"), ("Later", "outside window"), ("Undated", "no parseable dates")}
    assert build.without_copy(built).count() == 4 and build.records(build.normalised(raw)).count() == 7
    assert build.crawl_order(rows).select("title").collect()[-1]["title"] == "Undated"
    assert build.resolve_window(None, None, [AS_OF, AS_OF], AS_OF) == (AS_OF, AS_OF) and build.resolve_window(None, None, None, AS_OF, 1) == (AS_OF, D(2026, 9, 14))
    with pytest.raises(ValueError):
        build.select_ids({"a"}, ["x"], [])


def test_judgements(spark):
    turkish = "Bir adam sözlük yalnızlık çocukluk bir arı ya da kelimeler bencillik aşk kaybetmek çok aşk çok kaybetmek ve bir köpek kocaman gözleri olan"
    rows = events(spark, [show("The Table", byline="A puppet tragedy."), show("Yoga"), show("Ben", byline=turkish), show("Cached", tags=["musical"]), show("Silent"), show("Yoga")]).withColumn("prestar", F.lit(True))
    taste = judgement.Taste(batch=2)
    cached = rows.filter("title = 'Cached'").select(judgement.fingerprint(taste).alias("fp"), F.lit(True).alias("keep"), F.array(F.lit("film")).alias("tags"), F.lit(True).alias("star"), F.lit("x" * 200).alias("why"), F.lit(D(2026, 1, 1)).alias("last_seen"))
    old = spark.createDataFrame([("gone", False, [], False, "", D(2026, 1, 1)), ("recent", False, [], False, "", D(2026, 8, 1)), ("undated", False, [], False, "", None)], judgement.CACHE)

    def call(batch):
        assert len(batch) <= 2 and all(set(r) == {"i", "v", "t", "b", "d", "tags"} and r["t"] not in ("Ben", "Cached") for r in batch)
        return [{"i": r["i"], "keep": r["t"] != "Yoga", "tags": ["puppetry", "film"], "star": True} for r in batch if r["t"] != "Silent"]

    got = judgement.refine(rows, cached.unionByName(old), taste, F.lit(AS_OF), call)
    kept = {r["title"]: r["tags"] for r in got.kept.collect()}
    assert kept == {"The Table": ["puppetry"], "Cached": ["theatre"], "Silent": ["theatre"]} and "prestar" not in got.kept.columns
    stats = got.stats.first().asDict()
    assert stats == {"events": 6, "cache_hits": 1, "asked": 3, "dropped": 3, "retagged": 2}
    cache = {r["why"]: r for r in got.cache.collect()}
    assert got.cache.count() == 5 and cache["not English"]["keep"] is False and cache["x" * 120]["last_seen"] == AS_OF
    assert {r["fp"] for r in got.cache.collect()} >= {"recent"} and judgement.next_cache(judgement.judged(rows, old, taste), old, F.lit(AS_OF), prune=False).count() == 4
    silent = judgement.refine(rows, old.limit(0), taste, F.lit(AS_OF))
    assert silent.kept.count() == 5


def test_audits(spark):
    rows = events(spark, [
        show("Nothing"), show("Short", byline="Brief."), show("Credit", byline="By Ann Lee and friends of hers", description="x"), show("Sale", byline="General sale opens at noon on Friday", description="x"),
        show("Leak", byline="A story long enough for anyone at all", description="Join our newsletter"), show("The Whole Long Title Of It All", byline="The whole long title of it all.", description="x"), show("Echo", byline="A story long enough for anyone at all", description="A story long enough for anyone at all and more"),
    ])
    found = {}
    for r in audits.grade(rows, ["title"]).collect():
        found.setdefault(r["title"], []).append(r["rule"])
    assert found == {
        "Nothing": [audits.NO_COPY], "Short": ["byline but no description", "byline too short to sell anything"], "Credit": ["byline is a credit, not a hook"], "Sale": ["byline is booking chrome"],
        "Leak": ["boilerplate leaked in"], "The Whole Long Title Of It All": ["byline only restates the title"], "Echo": ["description just repeats the byline"],
    }
    told = audits.coverage(rows).first()
    assert (told["events"], told["venues"], told["bylines"], told["byline_percent"], told["descriptions"]) == (7, 1, 6, 85, 5)
    page = f"<nav><p>{LONG}</p></nav><p>short</p><p>{LONG.format('x')}</p>"
    live = audits.live(rows, spark.createDataFrame([("http://a/Echo", page)], "url string, body string"))
    assert {r["title"]: r["said"] for r in live.collect() if r["said"]} == {"Echo": [LONG.format("x")]}


def test_patches(spark):
    registry = spark.createDataFrame([("a", {"name": '"A"', "strategy": '"auto"', "blocked_by": '"x"', "notes": '"n"'}), ("b", {"name": '"B"'})], "id string, fields map<string,string>")
    patch = spark.createDataFrame([("a", {"notes": '"new"', "url_verified": "true"}), ("z", {"name": '"Z"'})], "id string, fields map<string,string>")
    got = {r["id"]: r for r in patches.merge(registry, patch, F.lit(AS_OF)).collect()}
    assert got["a"]["fields"] == {"name": '"A"', "notes": '"new"', "url_verified": "true", "last_verified": '"2026-09-07"'} and got["a"]["patched"]
    assert got["b"]["fields"] == {"name": '"B"'} and not got["b"]["patched"] and [r["id"] for r in patches.missed(registry, patch).collect()] == ["z"]
    urls = spark.createDataFrame([("a", None), ("b", "http://b"), ("c", "null"), ("d", None)], "id string, whats_on_url string")
    filled = {r["id"]: (r["whats_on_url"], r["outcome"]) for r in patches.fill_urls(urls, spark.createDataFrame([("a", "http://n"), ("b", "http://n"), ("c", "http://n"), ("d", "")], "id string, url string")).collect()}
    assert filled == {"a": ("http://n", "set"), "b": ("http://b", "kept"), "c": ("http://n", "set"), "d": (None, None)}
    lines = spark.createDataFrame([("a", 0, "k", "1"), ("a", 1, "l", "2"), ("a", 2, "k", "3")], "id string, pos int, key string, value string")
    assert {(r["key"], r["value"]) for r in patches.last_of_each(lines).collect()} == {("k", "3"), ("l", "2")} and patches.repeated(lines).first()["n"] == 2


SHOWS = [show("Horror", tags=["puppetry", "theatre"]), show("Yoga", "b", tags=["class"]), show("Dance", "b", tags=["dance"]), show("Concert", "b", tags=["concert"])]


def test_search(spark, venues):
    shows = events(spark, SHOWS)
    index = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.1, 0.9]), (2, [0.95, 0.05]), (3, [0.5, 0.5])], "owner int, vec array<float>")
    found = lambda *a, **k: [(r["id"], round(r["score"], 2)) for r in search.search(shows, index, *a, **k).collect()]
    assert [i for i, _ in found([[1.0, 0.0]])] == ["e000", "e002", "e003", "e001"] and found([[1.0, 0.0], [0.0, 1.0]], limit=1) == [("e000", 2.0)]
    assert found([], ["class", "dance"]) == [("e001", 0.0), ("e002", 0.0)] and found([[0.0, 1.0]], venue="b", limit=1) == [("e001", 0.9)]
    for bad in ([(9, [1.0, 0.0])], [(0, [1.0]), (1, [1.0, 2.0])], [(None, [1.0])], []):
        with pytest.raises(search.Unavailable):
            search.search(shows, spark.createDataFrame(bad, "owner int, vec array<float>"), [[1.0, 0.0]])
    told = events(spark, [show("Labyrinth", "arcola", "A horned shadow.", "Told via shadow-play. " * 30), show("Plain", "b")])
    chunks = {}
    for r in search.event_chunks(told, venues).orderBy("owner", "chunk_no").collect():
        chunks.setdefault(r["owner"], []).append(r["chunk"])
    assert chunks[0][:2] == ["Labyrinth · Arcola Theatre · Dalston, E8 · theatre", "A horned shadow."] and "puppetry" in chunks[0][-1] and "macabre" in chunks[0][-1] and len(chunks[0]) > 4
    assert chunks[1] == ["Plain · b · theatre"]
    made = search.embedded(search.event_chunks(told, venues))
    assert abs(made.select(F.round(search.dot(F.col("vec"), F.col("vec")), 3).alias("n")).agg(F.sum("n")).first()[0] - made.count()) < 0.01
    assert search.retrieve(told, made, venues, "horned shadow").first()["title"] == "Labyrinth"
    order = lambda q, rows: [rows[-1]["id"], "e999"]
    embed = lambda texts: np.array([[1.0, 0.0]] * len(texts))
    assert [r["id"] for r in search.retrieve(shows, index, venues, "x", embed, order=order, limit=2).collect()] == ["e001", "e000"]
    assert [r["id"] for r in search.retrieve(shows, index, venues, "x", embed, order=lambda *_: 1 / 0, limit=2).collect()] == ["e000", "e002"]
    assert search.retrieve(shows, index, venues, " ", tags=["dance"]).first()["id"] == "e002"
    answer = search.response(search.search(shows, index, [[1.0, 0.0]], limit=2)).first()
    assert (answer["ids"], answer["scores"], answer["count"]) == (["e000", "e002"], [1.0, 0.95], 2)
    assert search.parse_tags(" a, ,b") == ["a", "b"] and search.parse_tags("") is None and search.parse_tags(["x "]) == ["x"]


def test_readers_page(spark):
    rows = events(spark, [*SHOWS, show("Über Café!", last=D(2026, 9, 6))]).withColumns({"venue_name": F.col("venue_id"), "id": F.format_string("e%03d", "idx"), "key": facets.stable_key(F.col("venue_id"), F.col("title"))})
    assert rows.filter("idx = 4").first()["key"] == "a::u-ber-cafe" and facets.current(rows, F.lit(AS_OF)).count() == 4
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    seen = lambda **k: [r["title"] for r in facets.visible(facets.current(rows, F.lit(AS_OF)), keys("b::yoga"), keys("a::horror", "b::gone"), **k).collect()]
    assert sorted(seen()) == ["Concert", "Dance", "Horror"] and seen(mode="binned") == ["Yoga"] and seen(mode="starred") == ["Horror"]
    assert seen(tags=["class", "dance"]) == ["Dance"] and seen(venues=["a"]) == ["Horror"] and seen(first=D(2027, 1, 1), last=D(2027, 1, 2)) == []
    assert seen(subset=["e003", "e001", "e999", "e000"]) == ["Concert", "Horror"]
    assert [r["tag"] for r in facets.tag_facet(rows).orderBy("place").collect()] == ["theatre", "concert", "class", "dance", "puppetry"]
    assert {(r["name"], r["n"]) for r in facets.venue_facet(rows).collect()} == {("a", 2), ("b", 3)}
    many = rows.limit(1).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(399)))).withColumns({"key": F.col("k").cast("string"), "tags": F.when(F.col("k") < 40, F.array(F.lit("theatre"))).otherwise(F.array(F.lit("talk")))})
    order = [r["k"] for r in facets.shuffled(many, keys(*map(str, range(5))), 3).collect()]
    assert sorted(order) == list(range(400)) and sum(k < 40 for k in order[:100]) > 18 and order == [r["k"] for r in facets.shuffled(many, keys(*map(str, range(5))), 3).collect()]
    assert rows.select(facets.reader_row().alias("m")).first()["m"]["venue"] == "a"


def test_probe(spark):
    card = "<article class='x event-card'><a href=/s>t</a></article>"
    ld = '<script type="application/ld+json">{"@type": ["TheaterEvent", "Event"], "name": "n"%s}</script>'
    bodies = {
        "cards": card * 4 + ld % "", "linked": ld % ', "url": "u"', "sanity": "cdn.sanity.io/images/vs3yf10f/p/a.jpg", "rest": "<p>" + "w " * 900 + "</p>/wp-content/", "thin": "<p>x</p>", "sold": "spektrix.com " + "w " * 900,
        "feed": "<link rel='alternate' type='application/rss+xml' href='/feed'>" + "w " * 900,
    }
    pages = spark.createDataFrame([(f"http://{k}", f"http://{k}", 200, b) for k, b in bodies.items()], "url string, final_url string, status int, body string")
    venues = spark.createDataFrame([(k, f"http://{k}") for k in [*bodies, "lost"]] + [("none", None)], "id string, whats_on_url string")
    types = spark.createDataFrame([("http://rest", '{"event": {"rest_base": "gigs"}}')], "base string, body string")
    maps = spark.createDataFrame([], "base string, sitemap string")
    got = {r["id"]: r for r in probes.probe(venues, pages, types, maps).collect()}
    assert {k: (r["recommended_strategy"], r["recommended_tier"]) for k, r in got.items()} == {
        "cards": ("selectors", "1_jsonld"), "linked": ("jsonld", "1_jsonld"), "sanity": ("sanity", "2_cms"), "rest": ("wp_rest", "3_feed_or_selectors"), "thin": ("skip", "4_bespoke_or_search"),
        "sold": ("selectors", "2_platform"), "feed": ("selectors", "3_feed_or_selectors"), "lost": ("skip", "skip"), "none": ("skip", "skip"),
    }
    assert [(t["type"], t["n"]) for t in got["cards"]["jsonld_types"]] == [("Event", 1), ("TheaterEvent", 1)] and got["feed"]["feeds"] == ["/feed"] and got["sanity"]["sanity_project"] == "vs3yf10f"
    assert got["cards"]["cards"][0]["signature"] == "event-card.x" and got["rest"]["wp_rest"][0]["endpoint"] == "http://rest/wp-json/wp/v2/gigs"
    assert {r["signature"]: r["eventish"] for r in probes.suggested_cards(pages, "url", "body").collect()} == {"event-card.x": True}
    assert [(r["depth"], r["label"], r["text"]) for r in probes.outline(pages.filter("url = 'http://thin'"), "url", "body").collect()] == [(1, "p", "x")]
    hosts = spark.createDataFrame([("v", None, ["http://www.v.com/a", "http://v.com/b"])], "id string, whats_on_url string, url_candidates array<string>")
    answers = spark.createDataFrame([("http://www.v.com/a", "http://other.com/", 200, "x" * 900), ("http://v.com/b", "http://v.com/c", 200, "x" * 900)], "url string, final_url string, status int, body string")
    assert probes.resolved(hosts, answers).first()["whats_on_url"] == "http://v.com/c"
    urls = spark.createDataFrame([("http://v/index.php",), ("http://v/",), ("http://v/on?x",)], "u string")
    assert [r[0] for r in urls.select(probes.is_bare_home(F.col("u"))).collect()] == [True, True, False]
    walls = spark.createDataFrame([("Just a moment" + "x" * 900,), ("x" * 900,), ("x",)], "u string")
    assert [r[0] for r in walls.select(probes.is_challenge(F.col("u"))).collect()] == [True, False, True]
    rows = listed(spark, [("a", 0, "T", "http://a/1", D(2026, 9, 10), None, "d", ["x"]), ("a", 1, "U", "http://a/on/", D(2026, 9, 10), None, None, []), ("a", 2, "V", "http://a/2", None, None, None, [])]).withColumn("attempt", F.lit("jsonld"))
    scored = probes.score(rows, F.lit("http://a/on"), "venue_id", "attempt")
    assert tuple(scored.first())[2:] == (3, 2, 2, 1, 1, 1) and probes.best_attempt(scored, "venue_id", "attempt").first()["best"] == "jsonld"
    assert [r[0] for r in spark.createDataFrame([("<a href='/p'>Program</a>",)], "p string").select(probes.nav_links(F.lit("http://v/"), F.col("p"))).collect()] == [["http://v/p"]]


def test_sinks_swap_and_envelope(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.swap(spark.range(3), path)
    sinks.swap(spark.read.parquet(path).filter("id > 0"), path)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [1, 2]
    assert sinks.envelope(spark.range(3), AS_OF, AS_OF, AS_OF).first()["count"] == 3
    sinks.as_json(spark.sql("select 1 as a, cast(null as string) as b"), str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first()["value"] == '{"a":1,"b":null}' and listings.COLUMNS[1] == "pos"


def test_what_became_of_every_venue(spark):
    venues = spark.createDataFrame(
        [("ok", "http://ok/on", None, None), ("none", "", None, None), ("js", "http://js/on", "js_rendered", None), ("lost", "http://lost/on", None, None), ("down", "http://down/on", None, None), ("short", "http://short/on", None, True)],
        "id string, whats_on_url string, fetch_method string, skip_stage2 boolean",
    ).withColumns({c: F.lit(None).cast(k) for c, k in (("strategy", "string"), ("endpoint", "string"), ("lookahead_weeks", "int"))})
    pages = spark.createDataFrame([("http://ok/on", "<p>", None), ("http://ok/on", None, "timeout"), ("http://down/on", None, "HTTP 500"), ("http://short/on", "x", None)], "url string, body string, error string")
    day = datetime.date(2026, 9, 10)
    rows = spark.createDataFrame(
        [("ok", 0, "http://ok/1", None, day), ("ok", 1, "http://ok/1/", None, day), ("ok", 2, "http://ok/on/", None, day), ("ok", 3, None, None, day), ("ok", 4, "http://ok/2", "x" * 300, None), ("ok", 5, "http://ok/3", None, datetime.date(2030, 1, 1)), ("short", 0, "http://short/1", None, day)],
        "venue_id string, pos int, url string, description string, first_date date",
    ).withColumn("last_date", F.col("first_date"))
    shows = rows.filter("pos < 2")
    got = {r["venue_id"]: (r["shows"], r["hops"], r["status"]) for r in build.report(venues, rows, pages, shows, F.lit(datetime.date(2026, 9, 7))).collect()}
    assert got == {"ok": (2, 2, "ok"), "none": (0, 0, "skipped: no whats_on_url (unverified)"), "js": (0, 0, "skipped: js_rendered, needs a strategy"), "lost": (0, 0, "stage1 failed: not fetched"), "down": (0, 0, "stage1 failed: HTTP 500"), "short": (1, 0, "ok")}
