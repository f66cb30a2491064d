import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from stagehand.sources import details, listings, sections, tables

from .test_sources import CARDS

STRIP = "<section class='column-strip'><h6>Coming soon</h6><h2>Deep</h2><p>\U0001f4cd Here</p><a href='http://x/1'>go</a></section>"
PAGES = [(1, CARDS), (2, None), (3, ""), (4, STRIP), (5, "<h2>Title</h2><p>1 - 3 May 2027</p><a href='/title'>t</a>" + "<p>long " * 40)]
BY = {"show_card": ".card", "title": "h3", "space": ".room", "dates": "p > time", "blurb": ".b", "blurb_strip": "i", "tags": "li", "link": "a[href*='/show/']"}


@pytest.fixture
def pages(spark):
    tables.register(spark)
    rows = spark.createDataFrame([(i, b, BY, "http://f/on") for i, b in PAGES], "id int, body string, by map<string,string>, base string")
    rows.createOrReplaceTempView("table_pages")
    return rows


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("strategy", list(tables.TABLES))
def test_rows_are_those_of_the_pandas_functions(spark, pages, strategy):
    call, plain = {
        "selectors": ("stagehand_selectors(body, by, base)", listings.cards("body", "by", "base")),
        "dated_clusters": ("stagehand_dated_clusters(body)", details.boxes("body")),
        "immersive_rumours": ("stagehand_immersive_rumours(body)", sections.strips("body")),
    }[strategy]
    got = spark.sql(f"SELECT p.id, c.* FROM table_pages p, LATERAL {call} c")
    inside = pages.filter("body is not null").select("id", F.posexplode(plain).alias("n", "e"))
    want = inside.select("id", "e.*") if strategy == "dated_clusters" else inside.select("id", F.col("n").alias("pos"), "e.*")
    assert got.columns == want.columns and rows_of(got) == rows_of(want) != []


def test_arguments_are_checked_when_analysed(spark, pages):
    for call in ("stagehand_selectors(id, by, base)", "stagehand_selectors(body, map('title', 'h3'), base)", "stagehand_selectors(body, map('show_card', 1), base)", "stagehand_dated_clusters(body, 'x')", "stagehand_immersive_rumours(3)"):
        with pytest.raises(AnalysisException):
            spark.sql(f"SELECT c.* FROM table_pages p, LATERAL {call} c").schema
    assert spark.sql("SELECT c.* FROM stagehand_selectors(NULL, NULL, NULL) c").collect() == []


def test_shorter_boxes(spark, pages):
    assert {r["text"] for r in spark.sql("SELECT c.* FROM table_pages p, LATERAL stagehand_dated_clusters(p.body, 5) c WHERE p.id = 5").collect()} == {"Title", "long"}
