import json

import pytest
from pyspark.sql import functions as F

from stagehand.operators import tools


def answers(spark, texts, column):
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, a string")
    return [r["x"] for r in rows.select("n", column(F.col("a")).alias("x")).orderBy("n").collect()]


def test_interfaces():
    assert set(tools.TOOLS) == {"classify_events", "order_shows", "expand_query"}
    judged = tools.TOOLS["classify_events"]["input_schema"]["properties"]["results"]["items"]
    assert judged["required"] == ["i", "keep", "tags", "star"] and set(judged["properties"]) == {"i", "keep", "tags", "star", "why"}
    assert all(t["input_schema"]["additionalProperties"] is False and t["description"] for t in tools.TOOLS.values())
    json.dumps(tools.TOOLS)


@pytest.mark.parametrize("tool, field", [("order_shows", "ids"), ("expand_query", "phrases")])
def test_lists(spark, tool, field):
    got = answers(spark, [json.dumps({field: ["b", "a"]}), json.dumps({field: []}), json.dumps({field: None}), "{}", "no json", None, json.dumps({field: ["a", None]}), json.dumps([1])], lambda a: tools.read(a, tool)[field])
    assert got == [["b", "a"], [], None, None, None, None, None, None]


def test_judgements(spark):
    one = {"i": 0, "keep": True, "tags": ["dance"], "star": False}
    got = answers(spark, [json.dumps({"results": [one, one | {"i": 1, "why": "w"}, one | {"keep": False}]}), json.dumps({"results": [{"i": 0, "keep": True}]}), json.dumps({"results": []}), "x"], tools.verdicts)
    assert [(r["i"], r["keep"], r["why"]) for r in got[0]] == [(1, True, "w"), (0, False, None)]
    assert got[1:] == [None, [], None]
