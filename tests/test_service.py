import json
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from stagehand import service
from stagehand.operators import search


@pytest.fixture(scope="module")
def site(spark):
    rows = [(0, "a", "The Moon", ["opera"], "A tale of the moon and its people."), (1, "b", "Kettle", ["comedy"], "Jokes about kettles and tea."), (2, "a", "Tea Time", ["comedy", "talk"], "A talk on tea.")]
    events = spark.createDataFrame(rows, "idx int, venue_id string, title string, tags array<string>, description string").withColumns({"byline": F.lit(None).cast("string"), "url": F.lit("http://x/")})
    venues = spark.createDataFrame([("a", "The A", "E1"), ("b", "The B", None)], "id string, name string, area string")
    index = search.embedded(search.event_chunks(events, venues))
    up = service.server(service.Service(events, index, venues, "<h1>page</h1>"), 0)
    down = service.server(service.Service(events, None, venues), 0)
    for s in (up, down):
        threading.Thread(target=s.serve_forever, daemon=True).start()
    yield [f"http://127.0.0.1:{s.server_port}" for s in (up, down)]
    up.shutdown()
    down.shutdown()


def ask(url, body=None):
    try:
        with urllib.request.urlopen(urllib.request.Request(url, None if body is None else body.encode()), timeout=120) as r:
            return r.status, r.read().decode(), dict(r.headers)
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode(), dict(e.headers)


def test_paths(site):
    up, down = site
    assert ask(f"{up}/")[:2] == (200, "<h1>page</h1>")
    shows = json.loads(ask(f"{up}/api/shows")[1])["events"]
    assert [s["title"] for s in shows] == ["The Moon", "Kettle", "Tea Time"] and "idx" not in shows[0]
    got = json.loads(ask(f"{up}/api/search?q=the+moon")[1])
    assert got["ids"][0] == "e000" and got["count"] == len(got["ids"]) == 3 and got["scores"] == sorted(got["scores"], reverse=True)
    assert json.loads(ask(f"{up}/api/search?tags=comedy,+talk&limit=x")[1]) == {"ids": ["e001", "e002"], "scores": [0.0, 0.0], "count": 2}
    assert json.loads(ask(f"{up}/api/search?venue=a&limit=-3")[1])["ids"] == ["e000"]
    assert ask(f"{up}/none")[0] == 404 and ask(f"{up}/none", "{}")[0] == 404
    assert ask(f"{down}/api/search?q=x")[0] == 503 and ask(f"{down}/")[0] == 404


def test_tools(site):
    up, down = site
    call = lambda at, **r: json.loads(ask(f"{at}/mcp", json.dumps({"jsonrpc": "2.0", "id": 1, **r}))[1])
    assert [t["name"] for t in call(up, method="tools/list")["result"]["tools"]] == ["search_shows", "list_venues"]
    assert call(up, method="initialize")["result"]["serverInfo"]["name"] == "stagehand"
    venues = call(up, method="tools/call", params={"name": "list_venues"})["result"]["content"][0]["text"]
    assert json.loads(venues) == [{"venue_id": "a", "shows": 2}, {"venue_id": "b", "shows": 1}]
    found = call(up, method="tools/call", params={"name": "search_shows", "arguments": {"query": "kettle", "tags": ["comedy"], "limit": 1}})["result"]["content"][0]["text"]
    assert [(r["id"], r["title"]) for r in json.loads(found)] == [("e001", "Kettle")]
    assert call(down, method="tools/call", params={"name": "search_shows"})["result"]["isError"]
    assert call(up, method="other")["error"]["code"] == -32601
    status, body, headers = ask(f"{up}/mcp", json.dumps({"jsonrpc": "2.0", "method": "notifications/initialized"}))
    assert (status, body) == (202, "") and headers["Access-Control-Allow-Origin"] == "*"
    assert ask(f"{up}/mcp", "no json")[0] == 400
