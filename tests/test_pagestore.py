import datetime

import pytest
from pyspark.sql import functions as F

from stagehand.sources import fetching, pagestore

UTC = datetime.UTC
T0 = datetime.datetime(2026, 9, 1, tzinfo=UTC)


def page(url, hours, body="x", error=None, rendered=False):
    return (url, rendered, url, 200, body, error, T0 + datetime.timedelta(hours=hours))


@pytest.fixture
def stored(spark, tmp_path):
    first = [page("http://a/1", 0), page("http://a/2", 1), page("https://b.org/x?y", 2, None, "HTTP 500"), page(None, 3), page("no address", 4), page("http://a:8080/é", 5)]
    second = [page("http://a/1", 30, "new"), page("http://c/", 31, "long " * 50_000, rendered=True)]
    path = str(tmp_path / "pages")
    for rows in (first, second):
        pagestore.store(spark.createDataFrame(rows, fetching.PAGE), path)
    return path, first + second


def values(df):
    return sorted((tuple(r) for r in df.select(*[c.split()[0] for c in fetching.PAGE.split(", ")]).withColumn("fetched_at", F.unix_micros("fetched_at")).collect()), key=repr)


def expected(rows):
    return sorted(((*r[:-1], pagestore.micros(r[-1])) for r in rows), key=repr)


def test_what_is_stored_is_read(spark, stored):
    path, rows = stored
    got = pagestore.read(spark, path)
    assert values(got) == expected(rows)
    hosts = {r["url"]: r["host"] for r in got.collect()}
    assert hosts == {"http://a/1": "a", "http://a/2": "a", "https://b.org/x?y": "b.org", None: None, "no address": None, "http://a:8080/é": "a:8080", "http://c/": "c"}


def plan(df):
    return df._jdf.queryExecution().toString()


def test_filters_reach_the_files(spark, stored):
    path, rows = stored
    pages = pagestore.read(spark, path)
    one = pages.filter("host = 'a'")
    assert values(one) == expected([r for r in rows if (r[0] or "").startswith("http://a/")])
    logical, physical = plan(one).split("== Physical Plan ==")
    assert "= a)" in logical and "= a)" not in physical  # the source has taken it
    assert values(pages.filter(F.col("host").isin("c", "b.org", "none"))) == expected([r for r in rows if (r[0] or "")[-3:] in ("x?y", "/c/")])
    assert values(pages.filter("host = 'nowhere'")) == []
    assert values(pages.filter("host is null")) == expected([r for r in rows if r[0] in (None, "no address")])
    late = F.col("fetched_at") > F.lit(T0 + datetime.timedelta(hours=4))
    assert values(pages.filter(late)) == expected([r for r in rows if r[-1] > T0 + datetime.timedelta(hours=4)])
    assert values(pages.filter(late & (F.col("host") == "a"))) == expected(rows[6:7])
    assert values(pages) == expected(rows)  # nothing is left of the filters before
    assert values(pages.filter("batch > 0 and batch <= 5")) == expected(rows[6:]) and values(pages.filter("batch < 1")) == expected(rows[:6]) and values(pages.filter("batch = 1")) == expected(rows[6:])
    assert values(pages.filter("host = 'a' or rendered")) == expected([r for r in rows if r[1] or (r[0] or "").startswith("http://a/")])


def test_folders_of_other_hosts_are_not_listed(stored):
    path, _ = stored
    reader = pagestore.Reader(f"file:{path}", pagestore.SPLIT)
    assert list(reader.pushFilters([pagestore.EqualTo(("host",), "a"), pagestore.GreaterThan(("fetched_at",), T0)]))[0].attribute == ("fetched_at",)
    assert {h for p in reader.partitions() for _, h, _ in p.found} == {"a"}
    small = pagestore.Reader(f"file:{path}", 1)  # one file a task
    parts = small.partitions()
    assert all(len({h for _, h, _ in p.found}) == 1 for p in parts) and {h for p in parts for _, h, _ in p.found} == {"a", "a:8080", "b.org", "c", None}


def test_stream_reads_each_batch_once(spark, stored, tmp_path):
    path, rows = stored
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")

    def run():
        pagestore.stream(spark, path).writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination(120)
        return values(spark.read.parquet(out))

    assert run() == expected(rows)
    more = [page("http://d/", 40)]
    pagestore.store(spark.createDataFrame(more, fetching.PAGE), path)
    assert run() == expected(rows + more) == run()


def test_half_a_batch_is_not_read_and_a_number_is_replaced(spark, stored, tmp_path):
    path, rows = stored
    (tmp_path / "pages/batch=7/host=a").mkdir(parents=True)
    assert values(pagestore.read(spark, path)) == expected(rows)
    assert pagestore.store(spark.createDataFrame([page("http://z/", 1)], fetching.PAGE), path, 1) == 1
    assert values(pagestore.read(spark, path)) == expected([*rows[:6], page("http://z/", 1)])
    assert values(pagestore.read(spark, str(tmp_path / "nothing"))) == []
