import datetime

import pytest
from pyspark.sql import functions as F

from stagehand.operators.numbering import numbered


def test_places_are_those_of_row_number(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), F.when(F.col("id") % 3 > 0, F.col("id") % 11).alias("g"), F.create_map(F.lit("a"), F.col("id")).alias("m"))
    got = numbered(rows, F.col("g").desc_nulls_last(), "k", first=1, partitions=7)
    plan = got._jdf.queryExecution().toString()
    assert "Window" not in plan and "SinglePartition" not in plan
    rows_ = got.collect()
    want = sorted(rows_, key=lambda r: (r["g"] is None, -(r["g"] or 0), r["k"]))
    assert [r["idx"] for r in want] == list(range(1, 5001)) and got.columns == ["k", "g", "m", "idx"]


def test_one_key_in_most_rows_is_split(spark):
    rows = spark.range(6000).select(F.lit(1).alias("k"), "id")
    got = numbered(rows, "k", partitions=8).withColumn("file", F.input_file_name())
    files = [r["n"] for r in got.groupBy("file").agg(F.count("*").alias("n")).collect()]
    assert len(files) > 4 and max(files) < 2500 and sorted(r["idx"] for r in got.collect()) == list(range(6000))


def test_empty_repeated_and_null_rows(spark):
    none = spark.createDataFrame([], "a string, d date")
    assert numbered(none, "a").collect() == []
    rows = spark.createDataFrame([("x", None), ("x", None), (None, datetime.date(2026, 1, 1)), ("x", None)], "a string, d date")
    assert sorted((r["idx"], r["a"]) for r in numbered(rows, "a").collect()) == [(0, None), (1, "x"), (2, "x"), (3, "x")]


@pytest.mark.parametrize("first", [0, 10])
def test_first(spark, first):
    assert [r["n"] for r in numbered(spark.range(3), "id", name="n", first=first).orderBy("id").collect()] == [first, first + 1, first + 2]
