import json
import random

from pyspark.sql import functions as F

from stagehand.functions import linked


def page(*blocks):
    return "<html>" + "".join(f'<script type="application/ld+json">{b if isinstance(b, str) else json.dumps(b)}</script>' for b in blocks) + "<p>x</p></html>"


def plain(blocks):
    """Typed objects in the order of a stack, keys of an object in alphabetical order."""
    out = []
    for b in blocks:
        todo = [b]
        while todo:
            at = todo.pop()
            if isinstance(at, dict):
                if at.get("@type"):
                    kinds = at["@type"]
                    out.append((",".join(kinds) if isinstance(kinds, list) else kinds, at.get("name"), sorted(at)))
                at = [v for _, v in sorted(at.items())]
            if isinstance(at, list):
                todo.extend(x for x in at if isinstance(x, dict | list))
    return out


def grown(rng, depth):
    if depth == 0 or rng.random() < 0.2:
        return rng.choice([1, "x", None, True, 2.5])
    if rng.random() < 0.4:
        return [grown(rng, depth - 1) for _ in range(rng.randrange(4))]
    tree = {rng.choice("abcdef"): grown(rng, depth - 1) for _ in range(rng.randrange(4))}
    if rng.random() < 0.7:
        tree |= {"@type": rng.choice(["Event", "Place", ["MusicEvent", "Event"], "Thing"]), "name": rng.choice(["n", "m"])}
    return tree


def test_walk_against_plain_version(spark):
    rng = random.Random(6)
    pages = [[grown(rng, 6) for _ in range(rng.randrange(4))] for _ in range(60)]
    deep = {"@type": "Deep"}
    for i in range(150):
        deep = {"a": [deep]}
    pages.append([deep, {"@type": "Last"}])
    rows = spark.createDataFrame([(i, page(*p)) for i, p in enumerate(pages)], "id int, body string")
    got = {r["id"]: r for r in linked.with_objects(rows, "body").collect()}
    for i, p in enumerate(pages):
        assert [(n["type"], n["title"], n["keys"]) for n in got[i]["_nodes"]] == plain(p), p
        assert got[i]["_blocks"] == len(p)


def test_fields_and_odd_pages(spark):
    event = {"@type": "TheaterEvent", "name": "One", "url": 7, "startDate": "2026-10-01", "endDate": None, "description": "d", "offers": {"price": 12.5}}
    free = {"@type": "Event", "name": ["no text"], "offers": {"price": 0}, "x": {"@type": ""}}
    many = {"@type": "Event", "offers": [{"price": 3}]}
    rows = [(1, page([event, free], "not json", many)), (2, page([event, free], "not json", many)), (3, None), (4, ""), (5, "<script>no data</script>"), (6, page("  \n", '{"a":1,"a":2}'))]
    got = {r["id"]: r for r in linked.with_objects(spark.createDataFrame(rows, "id int, body string"), "body").collect()}
    assert len(got) == 6 and got[1]["_nodes"] == got[2]["_nodes"] and [got[i]["_blocks"] for i in range(1, 7)] == [3, 3, None, 0, 0, 2]
    first, second, third = got[1]["_nodes"]
    assert (second["type"], second["title"], second["url"], second["start"], second["end"], second["price"]) == ("TheaterEvent", "One", None, "2026-10-01", None, "12.5")
    assert (first["title"], first["price"], third["price"]) == (None, None, None)
    assert all(got[i]["_nodes"] == [] for i in (3, 4, 5, 6))


def test_no_python_in_the_plan(spark):
    rows = spark.createDataFrame([(1, page({"@type": "Event"}))], "id int, body string")
    plan = linked.with_objects(rows, "body").select(F.size(linked.events(F.col("_nodes"))))._jdf.queryExecution().toString()
    assert "Python" not in plan.replace("PythonRDD", "") and "UnionLoop" in plan


def test_the_walk_in_a_row_gives_the_same_objects(spark):
    rng = random.Random(7)
    pages = [page(*[grown(rng, 6) for _ in range(rng.randrange(4))]) for _ in range(40)]
    deep = {"@type": "Deep"}
    for i in range(60):
        deep = {"a": [deep]}
    event = {"@type": "Event", "name": "One", "startDate": "2026-10-01", "offers": {"price": 12.5}}
    pages += [page(deep, {"@type": "Last"}), None, "", page("not json", event, '{"a":1,"a":2}'), page('{"\\u0040type":"Event","x":{"\\u0040type":"B"}}'), page('{"\\u0040type":"Event"}'), page('{"a":{"@type":"Only"}}')]
    pages += [page('{"@type":""}', '{"@type":null}', '[{"@type":"Event"}]', '{"@type":"Event","name":"@type"}', '{"@type":{"@type":"In"}}'), '<SCRIPT type=APPLICATION/LD+JSON>{"@type":"Event","offers":{"price":"9.50"}}</script>']
    rows = spark.createDataFrame(list(enumerate(pages)), "id int, body string")
    want = {r["id"]: r["_nodes"] for r in linked.with_objects(rows, "body").collect()}
    got = rows.select("id", linked.nodes(F.col("body")).alias("n"), linked.nodes(F.col("body"), "type", "price").alias("some")).collect()
    assert {r["id"]: r["n"] for r in got} == want and [n["type"] for r in got for n in r["n"]].count("Deep") == 1
    assert all([tuple(x) for x in r["some"]] == [(x["type"], x["price"]) for x in want[r["id"]]] for r in got)
