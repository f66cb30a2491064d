"""Snapshots with a hash tree: two of them are compared from the root down, and only the leaves that differ are read.

A row's leaf is a range of the hash of its key. A leaf's digest sums two hashes of its rows, whatever their order; a node's digest is that of its
children's. Rows are stored by leaf, so reading some leaves is reading some folders. The driver holds the numbers of the nodes that
differ on a level, at most ``fan ** depth``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagehand.operators.snapshots import difference

FAN, DEPTH = 16, 3


def save(rows: DataFrame, keys: list[str], path: str, fan: int = FAN, depth: int = DEPTH) -> None:
    """Writes a snapshot and its tree: ``rows`` by leaf and ``tree`` (``level``, ``node``, ``n``, ``digest``), the root being level 0."""
    at = path.rstrip("/")
    content = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    marked = rows.withColumn("leaf", F.pmod(F.xxhash64(*keys), F.lit(fan**depth)).cast("int"))
    marked.repartitionByRange("leaf", F.xxhash64(content)).write.mode("overwrite").partitionBy("leaf").parquet(f"{at}/rows")
    hashes = [F.sum(h.cast("decimal(38,0)")).cast("string") for h in (F.xxhash64(content), F.xxhash64(F.lit("second"), content))]
    level = marked.groupBy(F.col("leaf").alias("node")).agg(F.count("*").alias("n"), F.sha2(F.concat_ws("|", F.count("*").cast("string"), *hashes), 256).alias("digest")).withColumn("level", F.lit(depth))
    for up in range(depth, -1, -1):
        level.select("level", "node", "n", "digest").write.mode("overwrite" if up == depth else "append").partitionBy("level").parquet(f"{at}/tree")
        below = _nodes(rows.sparkSession, at, up)
        children = F.array_sort(F.collect_list(F.struct("node", "digest")))  # at most ``fan``
        level = below.groupBy(F.floor(F.col("node") / fan).cast("int").alias("node")).agg(F.sum("n").alias("n"), F.sha2(F.to_json(children), 256).alias("digest")).withColumn("level", F.lit(up - 1))


def _nodes(spark: SparkSession, path: str, level: int) -> DataFrame:
    """(``node``, ``n``, ``digest``) of a level; a snapshot without rows has none."""
    return spark.read.schema("node int, n bigint, digest string, level int").parquet(f"{path.rstrip('/')}/tree").filter(F.col("level") == level).drop("level")


def differing(spark: SparkSession, old: str, new: str, fan: int = FAN, depth: int = DEPTH) -> list[int]:
    """The leaves whose rows differ, found level by level below nodes that differ."""
    found = [0]
    for level in range(depth + 1):
        if not found:
            return []
        sides = [_nodes(spark, p, level).filter(F.col("node").isin(found)).select("node", F.col("digest").alias(n)) for p, n in ((old, "a"), (new, "b"))]
        odd = sorted(r["node"] for r in sides[0].join(sides[1], "node", "full").filter(~F.col("a").eqNullSafe(F.col("b"))).select("node").collect())
        found = odd if level == depth else [n * fan + i for n in odd for i in range(fan)]
    return found


def leaves(spark: SparkSession, path: str, wanted: list[int], schema) -> DataFrame:
    """The rows of some leaves; other folders aren't read."""
    rows = spark.read.schema(schema).parquet(f"{path.rstrip('/')}/rows")
    return rows.filter(F.col("leaf").isin(wanted) if wanted else F.lit(False)).drop("leaf")


def changed(old: str, new: str, keys: list[str], rows: DataFrame, fan: int = FAN, depth: int = DEPTH) -> DataFrame:
    """Keys ``added`` or ``gone`` between two saved snapshots, in ``change``; ``rows`` tells their schema."""
    spark = rows.sparkSession
    wanted = differing(spark, old, new, fan, depth)
    schema = rows.withColumn("leaf", F.lit(0)).schema
    return difference(leaves(spark, old, wanted, schema), leaves(spark, new, wanted, schema), keys)
