import datetime
import http.server
import threading
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from stagehand.sources import fetching

NOW = datetime.datetime(2026, 9, 7, 12)


@pytest.fixture(scope="module")
def site():
    seen = defaultdict(list)

    class Pages(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            seen[self.headers["Host"]].append((time.monotonic(), self.path))
            if self.path == "/moved":
                self.send_response(302)
                self.send_header("Location", "/here")
                self.end_headers()
                return
            body = f"<p>café {self.path}</p>".encode("latin-1")
            self.send_response(404 if self.path == "/none" else 200)
            self.send_header("Content-Type", "text/html; charset=latin-1")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield server.server_port, seen
    server.shutdown()


def test_fetches_each_page_once_with_pauses_by_host(spark, site, tmp_path):
    port, seen = site
    a, b, path = f"http://127.0.0.1:{port}", f"http://localhost:{port}", str(tmp_path / "pages")
    urls = [f"{a}/{i}" for i in range(4)] + [f"{b}/{i}" for i in range(4)] + [f"{a}/none", f"{b}/moved", f"{a}/0", "", None, "ftp://x/y"]
    asked = spark.createDataFrame([(u, False) for u in urls] + [(f"{a}/0", True)], "url string, rendered boolean")
    fetching.refresh(asked, path, F.lit(NOW), 12, 3, pauses=(0.2, 0.2))
    got = {(r["url"], r["rendered"]): r for r in spark.read.parquet(path).collect()}
    assert len(got) == 12 and spark.read.parquet(path).count() == 12
    assert got[f"{a}/1", False]["body"] == "<p>café /1</p>" and got[f"{a}/1", False]["status"] == 200
    assert got[f"{b}/moved", False]["final_url"] == f"{b}/here"
    assert got[f"{a}/none", False]["status"] == 404 and got[f"{a}/none", False]["error"] == "HTTP 404"
    assert "no browser" in got[f"{a}/0", True]["error"] and "not a web address" in got["ftp://x/y", False]["error"]
    for times in seen.values():
        gaps = [y - x for (x, _), (y, p) in zip(times, times[1:]) if p != "/here"]
        assert min(gaps) > 0.19


def test_only_stale_and_failed_pages_are_due(spark):
    hours = lambda n: NOW - datetime.timedelta(hours=n)
    pages = spark.createDataFrame([("u", False, "u", 200, "x", None, hours(1)), ("v", False, "v", 200, "x", None, hours(13)), ("w", False, None, 500, None, "HTTP 500", hours(1))], fetching.PAGE)
    asked = spark.createDataFrame([("u", False), ("u", True), ("v", False), ("w", False), ("n", False), ("n", False)], "url string, rendered boolean")
    got = fetching.due(asked, pages, F.lit(NOW), 12)
    assert sorted(map(tuple, got.collect())) == [("n", False), ("u", True), ("v", False), ("w", False)]
    assert fetching.due(asked.limit(0), pages, F.lit(NOW), 12).count() == 0
    assert sorted(r["url"] for r in fetching.latest(pages).collect()) == ["u", "v"]


def test_requests_of_venues_and_shows(spark):
    venues = spark.createDataFrame([("a", "http://a/on", None, None, None, None), ("b", None, None, None, None, None), ("c", "http://c/on", "wp_rest", "http://c/api", "js_rendered", None), ("d", "http://d/on", None, None, None, True)], "id string, whats_on_url string, strategy string, endpoint string, fetch_method string, skip_stage2 boolean")
    assert sorted(map(tuple, fetching.of_listings(venues).select("url", "rendered").collect())) == [("http://a/on", False), ("http://c/api", True), ("http://d/on", False)]
    rows = spark.createDataFrame([("a", "http://a/1", None, None), ("a", "http://a/on/", None, None), ("c", "http://c/1", "x" * 300, NOW.date()), ("c", "http://c/2", None, NOW.date()), ("d", "http://d/1", None, None)], "venue_id string, url string, description string, first_date date")
    assert sorted(map(tuple, fetching.of_details(rows, venues).select("url", "rendered").collect())) == [("http://a/1", False), ("http://c/2", True)]


def test_hasty_rows(spark):
    at = lambda s: NOW + datetime.timedelta(seconds=s)
    log = spark.createDataFrame([("a", at(0)), ("a", at(1)), ("a", at(3)), ("b", at(1)), ("b", at(2.5))], "host string, t timestamp")
    assert [(r["host"], r["waited"]) for r in fetching.hasty(log, "host", ["t"], 1.5).collect()] == [("a", 1.0)]


def test_a_listing_is_waited_for_and_its_shows_are_not(spark):
    venues = spark.createDataFrame([("a", "http://a/on", "rendered", None, ".show", None), ("b", "http://b/on", None, True, "", None), ("c", "http://c/on", None, None, ".x", None)], "id string, whats_on_url string, fetch_method string, render boolean, render_wait string, skip_stage2 boolean").withColumns({"strategy": F.lit(None).cast("string"), "endpoint": F.lit(None).cast("string")})
    rows = spark.createDataFrame([("a", "http://a/1", None, None), ("c", "http://c/1", None, None)], "venue_id string, url string, description string, first_date date")
    listed = {(r["url"], r["rendered"], r["wait"]) for r in fetching.of_listings(venues).collect()}
    assert listed == {("http://a/on", True, ".show"), ("http://b/on", True, None), ("http://c/on", False, None)}
    shows = {(r["url"], r["rendered"], r["wait"]) for r in fetching.of_details(rows, venues).collect()}
    assert shows == {("http://a/1", True, None), ("http://c/1", False, None)}
    asked = fetching.of_listings(venues).unionByName(fetching.of_details(rows, venues))
    got = {r["url"]: r["body"] for r in fetching.fetch(asked, 2, lambda u: (u, 200, "plain"), lambda u, wait: (u, 200, f"waited for {wait}"), (0, 0)).collect()}
    assert got == {"http://a/on": "waited for .show", "http://b/on": "waited for None", "http://c/on": "plain", "http://a/1": "waited for None", "http://c/1": "plain"}
    old = spark.createDataFrame([], fetching.PAGE)
    again = asked.unionByName(spark.createDataFrame([("http://a/on", True, None)], "url string, rendered boolean, wait string"))
    assert [r["wait"] for r in fetching.due(again, old, F.current_timestamp(), 1).filter("url = 'http://a/on'").collect()] == [".show"]
