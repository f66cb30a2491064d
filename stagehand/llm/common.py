"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"
#: Order keys are the first 15 hex digits of an MD5, so they lie below this.
KEY_SPACE = 1 << 60


def scratch_dir(spark: SparkSession) -> str:
    """The folder for cut lineage: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        base = tempfile.mkdtemp(prefix="stagehand-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    The written table survives lost executors; it goes by ``forget``, or when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, at = _at(spark, path)
    files.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut = path
    MADE.append(path)
    return out


#: Paths of the tables written by ``cut`` and not yet deleted, oldest first.
MADE: list[str] = []


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def forget(*tables: DataFrame) -> None:
    """Deletes tables made by ``cut`` that nothing still to be run reads."""
    for t in tables:
        _delete(t.sparkSession, t._cut)


def _delete(spark: SparkSession, path: str) -> None:
    files, at = _at(spark, path)
    files.delete(at, True)
    if path in MADE:
        MADE.remove(path)


@contextmanager
def swept(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes what ``cut`` made inside the block, but the tables put into the list that it gives."""
    before, keep = set(MADE), []
    yield keep
    kept = {t._cut for t in keep}
    for path in [p for p in MADE if p not in before and p not in kept]:
        _delete(spark, path)


def n_words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_key(seed: str, *columns: Column) -> Column:
    """A shuffled but repeatable position below ``KEY_SPACE``, from an MD5 of the columns."""
    whole = F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(whole), 1, 15), 16, 10).cast("long")


def shard_of(key: Column, shards: int) -> Column:
    """Which of ``shards`` equal ranges of the key space a key falls in."""
    return F.floor(key / F.lit(KEY_SPACE // shards)).cast("long")


def shards_for(rows: int, per_shard: int = 50_000, least: int = 256) -> int:
    """Number of key ranges, so that a range of one group holds about ``per_shard`` rows at most."""
    return max(least, -(-rows // per_shard))


def running_total(df: DataFrame, group: str, key: str, value: Column, shards: int, name: str, peers: bool) -> DataFrame:
    """Adds ``name``: the total of ``value`` up to each row in the order of ``key`` within ``group``.

    A group is cut into ranges of the key, each summed by its own task, and the
    ranges' totals are carried over by a small join; so a group may hold any share
    of the rows. ``peers``: rows of equal key all get the total after the last.
    """
    df = df.withColumn("_shard", shard_of(F.col(key), shards)).withColumn("_value", value)
    totals = df.groupBy(group, "_shard").agg(F.sum("_value").alias("_total"))
    before = Window.partitionBy(group).orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(group, "_shard", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(group, "_shard").orderBy(key)
    inside = inside.rangeBetween(Window.unboundedPreceding, 0) if peers else inside.rowsBetween(Window.unboundedPreceding, 0)
    return (
        df.withColumn("_local", F.sum("_value").over(inside))
        .join(offsets, [group, "_shard"])
        .withColumn(name, F.col("_local") + F.col("_offset"))
        .drop("_shard", "_value", "_local", "_offset")
    )
