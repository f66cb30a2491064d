import datetime
import json

from pyspark.sql import functions as F

from stagehand.sources import listings, probes, validation

NOW = datetime.date(2026, 9, 7)


def test_the_best_try_of_each_venue(spark):
    show = {"@type": "Event", "name": "One", "startDate": "2026-09-10"}
    card = "<article class='show big'><h3>T{0}</h3><time>{0} October 2026</time><a href='/s/{0}'>more</a></article>"
    cards = "".join(card.format(i) for i in range(1, 6))
    pages = [
        ("http://a/on", f'<script type="application/ld+json">{json.dumps(show)}</script>{cards}'),
        ("http://b/on", f'<script type="application/ld+json">{json.dumps({**show, "url": "http://b/1"})}</script><p>wp-content</p>'),
        ("http://c/api", json.dumps([{"title": {"rendered": "W"}, "link": "http://c/w", "when": "3 October 2026"}])),
        ("http://c/on", "<p>nothing here</p>"),
    ]
    rows = [("a", "http://a/on", None, None, None), ("b", "http://b/on", "jsonld", None, None), ("c", "http://c/on", "wp_rest", "http://c/api", "when"), ("d", None, None, None, None)]
    schema = spark.createDataFrame([], listings.VENUE).schema
    keys = ("id", "whats_on_url", "strategy", "endpoint", "dates_field")
    venues = spark.createDataFrame([tuple(dict(zip(keys, r)).get(f.name) for f in schema) for r in rows], schema)
    pages = spark.createDataFrame([(u, u, 200, b) for u, b in pages], "url string, final_url string, status int, body string")
    none = lambda s: spark.createDataFrame([], s)
    signals = probes.probe(venues, pages, none("base string, body string"), none("base string, sitemap string"))
    got = {r["id"]: r for r in validation.validate(venues, signals, pages, F.lit(NOW)).collect()}
    assert set(got) == set("abcd")
    a = {s["attempt"]: s for s in got["a"]["scores"]}
    assert set(a) == {"jsonld", "selectors:probe"}
    assert (a["jsonld"]["n"], a["jsonld"]["useful"]) == (1, 0) and (a["selectors:probe"]["n"], a["selectors:probe"]["useful"]) == (5, 5)
    assert (got["a"]["probe"], got["a"]["registry"], got["a"]["best"], got["a"]["agrees"], got["a"]["probe_works"]) == ("selectors", "auto", "selectors:probe", True, True)
    assert (got["b"]["probe"], got["b"]["best"], got["b"]["agrees"]) == ("jsonld", "jsonld", True)
    assert (got["c"]["best"], got["c"]["agrees"]) == ("wp_rest", False)
    assert (got["d"]["probe"], got["d"]["best"], got["d"]["probe_works"]) == ("skip", "jsonld", False)


def test_tries_complete_settings_from_signals(spark):
    schema = spark.createDataFrame([], listings.VENUE).schema
    venues = spark.createDataFrame([tuple({"id": "a", "whats_on_url": "http://a/on", "selectors": {"show_card": ".x"}}.get(f.name) for f in schema)], schema)
    signals = spark.createDataFrame(
        [("a", "http://a/on", "http://www.a/on", [(1, "card.big", 5)], "p1", [("show", "show", "http://www.a/wp-json/wp/v2/show")])],
        "id string, url string, final_url string, cards array<struct<place:int,signature:string,n:int>>, sanity_project string, wp_rest array<struct<slug:string,rest_base:string,endpoint:string>>",
    )
    got = {r["attempt"]: r for r in validation.tries(venues, signals).collect()}
    assert set(got) == {"jsonld", "selectors", "selectors:probe", "sanity", "wp_rest"}
    assert got["selectors"]["selectors"] == {"show_card": ".x"} and got["selectors:probe"]["selectors"]["show_card"] == ".card.big"
    assert got["sanity"]["show_url_pattern"] == "http://www.a/events/{slug}" and got["sanity"]["endpoint"].startswith("https://p1.api.sanity.io/v2021-10-21/data/query/production?query=%2A%5B")
    assert got["wp_rest"]["endpoint"] == "http://www.a/wp-json/wp/v2/show?per_page=20"
