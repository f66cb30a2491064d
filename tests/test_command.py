import json

from stagehand.__main__ import main
from stagehand.sources import fetching


def test_from_pages_to_the_page(spark, tmp_path, capsys):
    at = lambda name: str(tmp_path / name)
    (tmp_path / "venues.json").write_text(json.dumps([{"id": "a", "name": "The A", "whats_on_url": "http://a/on", "strategy": "jsonld"}, {"id": "b"}]))
    shows = [{"@type": "Event", "name": "One", "url": "http://a/1", "startDate": "2026-09-10"}, {"@type": "Event", "name": "ONE!", "url": "http://a/2", "startDate": "2026-09-12"}, {"@type": "Event", "name": "Far", "startDate": "2028-01-01"}]
    spark.createDataFrame([("http://a/on", f'<script type="application/ld+json">{json.dumps(shows)}</script>')], "url string, body string").write.parquet(at("pages"))
    assert main(["extract", "--venues", at("venues.json"), "--pages", at("pages"), "--out", at("raw"), "--as-of", "2026-09-07"], spark) == 0
    assert spark.read.parquet(at("raw")).count() == 1
    build = ["build", "--raw", at("raw"), "--venues", at("venues.json"), "--snapshots", at("snaps"), "--generated"]
    assert main([*build, "2026-09-07", "--start", "2026-09-07", "--end", "2026-11-01"], spark) == 0
    assert main(["changed", "--snapshots", at("snaps"), "--generated", "2026-09-07"], spark) == 0
    assert main([*build, "2026-09-14", "--start", "2026-09-07", "--end", "2026-11-01"], spark) == 0
    assert main(["changed", "--snapshots", at("snaps"), "--generated", "2026-09-14"], spark) == 1
    assert main([*build, "2026-09-21", "--start", "2026-09-20", "--end", "2026-11-01"], spark) == 2
    assert main(["audit", "--snapshot", at("snaps/generated=2026-09-14")], spark) == 0
    assert "no copy at all: a 1" in capsys.readouterr().out
    (tmp_path / "t.html").write_text("<p>/*__EVENTS__*/[]</p>")
    assert main(["page", "--snapshot", at("snaps/generated=2026-09-14"), "--venues", at("venues.json"), "--template", at("t.html"), "--out", at("out")], spark) == 0
    page = spark.read.text(at("out")).first()["value"]
    got = json.loads(page.removeprefix("<p>").removesuffix("</p>"))
    assert [(e["title"], e["first_date"], e["last_date"], e["venue_name"]) for e in got] == [("ONE!", "2026-09-10", "2026-09-12", "The A")]  # of several events in a page the last comes first


def test_from_a_snapshot_to_answers(spark, tmp_path, capsys):
    at = lambda name: str(tmp_path / name)
    (tmp_path / "venues.json").write_text(json.dumps([{"id": "a", "name": "The A"}, {"id": "b"}]))
    told = "The people of the moon tell a long tale about the sea, and it is all that they have left of home in the dark of the night."
    rows = [("a", "Moon", told, "2026-09-10", ["opera"]), ("b", "Ay", "Bu oyun bir ay hakkında ve çok uzun bir hikaye anlatıyor, yirmi kelimeden daha uzun olan bu metin İngilizce değildir ve hiç olmadı zaten.", "2026-09-11", ["talk"]), ("b", "Kettle", None, "2026-09-12", ["comedy"])]
    df = spark.createDataFrame([(v, t, None, d, w, w, "u", g) for v, t, d, w, g in rows], "venue_id string, title string, byline string, description string, first_date string, last_date string, url string, tags array<string>")
    df.write.parquet(at("snap"))
    refine = ["refine", "--snapshot", at("snap"), "--cache", at("cache"), "--out", at("kept"), "--as-of", "2026-09-07"]
    assert main([*refine, "--dry-run"], spark) == 0 and not (tmp_path / "kept").exists()
    assert main(refine, spark) == 0 and main(refine, spark) == 0
    assert sorted(r["title"] for r in spark.read.parquet(at("kept")).collect()) == ["Kettle", "Moon"]
    assert "dropped: 1" in capsys.readouterr().out
    common = ["--snapshot", at("kept"), "--venues", at("venues.json")]
    assert main(["embed", *common, "--out", at("index")], spark) == 0
    assert main(["search", *common, "--index", at("index"), "tale of the moon"], spark) == 0
    assert capsys.readouterr().out.splitlines()[0].startswith("e000 ")
    assert main(["search", *common, "--index", at("index"), "--tags", "comedy"], spark) == 0
    assert capsys.readouterr().out.strip() == "e001 0.0000 b Kettle"


def test_from_pages_to_a_patched_registry(spark, tmp_path, capsys):
    at = lambda name: str(tmp_path / name)
    registry = [{"id": "a", "whats_on_url": "http://a.org/on", "strategy": "auto", "seasonal": True}, {"id": "b", "whats_on_url": "http://b.org/on"}]
    (tmp_path / "venues.json").write_text(json.dumps({"venues": registry}))
    cards = "".join(f"<article class='show'><h3>T{i}</h3><time>{i} October 2026</time><a href='/s/{i}'>more</a></article>" for i in range(1, 6))
    page = lambda url, body, status=200: (url, False, url, status, body, None, None)
    pages = [page("http://a.org/on", "<link href=/wp-content/x.css>" + cards + "x" * 800), page("http://a.org/sitemap.xml", "<urlset>"), page("http://a.org/wp-json/wp/v2/types", json.dumps({"show": {"rest_base": "shows"}})), page("http://b.org/on", "gone", 404)]
    spark.createDataFrame(pages, fetching.PAGE).selectExpr("* except (fetched_at)", "timestamp '2026-09-07' as fetched_at").write.parquet(at("pages"))
    common = ["--venues", at("venues.json"), "--pages", at("pages")]
    assert main(["probe", *common, "--out", at("probe")], spark) == 0
    got = {r["id"]: r for r in spark.read.json(at("probe")).collect()}
    assert got["a"]["recommended_strategy"] == "selectors" and got["a"]["sitemap"] == "http://a.org/sitemap.xml" and got["a"]["wp_rest"][0]["endpoint"] == "http://a.org/wp-json/wp/v2/shows"
    assert main(["validate", *common, "--out", at("valid"), "--as-of", "2026-09-07"], spark) == 0
    assert {r["id"]: r["best"] for r in spark.read.json(at("valid")).collect()}["a"] == "selectors:probe"
    assert main(["urls", *common, "--out", at("urls")], spark) == 0
    assert {r["id"]: r["whats_on_url"] for r in spark.read.json(at("urls")).collect()} == {"a": "http://a.org/on", "b": None}
    capsys.readouterr()
    assert main(["inspect", "--pages", at("pages"), "--url", "http://a.org/on"], spark) == 0
    assert capsys.readouterr().out.strip() == "5 show"
    (tmp_path / "patches.json").write_text(json.dumps([{"id": "a", "strategy": "selectors"}, {"id": "z", "strategy": "skip"}]))
    assert main(["patch", "--registry", at("venues.json"), "--patches", at("patches.json"), "--out", at("patched"), "--as-of", "2026-09-07"], spark) == 0
    assert capsys.readouterr().out.strip() == "no venue z"
    fields = {r["id"]: r["fields"] for r in spark.read.parquet(at("patched")).collect()}
    assert fields["a"] == {"whats_on_url": '"http://a.org/on"', "seasonal": "true", "strategy": '"selectors"', "last_verified": '"2026-09-07"'} and fields["b"] == {"whats_on_url": '"http://b.org/on"'}
