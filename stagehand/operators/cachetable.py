"""The judgement cache as a bucketed table: rows are looked up and entries replaced without moving the cache.

A generation is a folder of Parquet in buckets of the key. The session's catalogue is told of its buckets when it is opened, so
a join by the key reads each bucket in one task, with no exchange above the scan; only what is looked up is shuffled. A new generation is
the old one with entries put in bucket by bucket, written beside it; ``_SUCCESS`` makes it the current one, and a failed write changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class CacheTable:
    """A cache at ``path`` by ``key``; entries with equal keys are one."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, buckets: int = 64):
        self.spark, self.path, self.key, self.schema, self.buckets = spark, path.rstrip("/"), key, schema, buckets

    def _files(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def generation(self) -> int:
        """The number of the current generation, -1 before the first."""
        files, at = self._files(f"{self.path}/generation=*/_SUCCESS")
        return max((int(str(s.getPath().getParent().getName()).split("=")[1]) for s in files.globStatus(at) or []), default=-1)

    def entries(self) -> DataFrame:
        """The current entries, with their buckets known."""
        number = self.generation()
        if number < 0:
            return self.spark.createDataFrame([], self.schema)
        where = f"{self.path}/generation={number}"
        name = f"cache_{abs(hash(where)):x}"
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({self.schema}) USING parquet CLUSTERED BY ({self.key}) SORTED BY ({self.key}) INTO {self.buckets} BUCKETS LOCATION '{where}'")
        return self.spark.table(name)

    def lookup(self, rows: DataFrame) -> DataFrame:
        """Rows with their cached entry, or nulls."""
        return rows.join(self.entries().hint("merge"), self.key, "left")

    def pending(self, rows: DataFrame) -> DataFrame:
        """Rows without an entry."""
        return rows.join(self.entries().select(self.key).hint("merge"), self.key, "left_anti")

    def put(self, new: DataFrame, keep: Column | None = None) -> None:
        """The next generation: ``new`` entries in place of old ones of their keys, and of the others those that ``keep`` holds for."""
        names = [c.split()[0] for c in self.schema.split(", ")]
        old, number = self.entries(), self.generation()
        first = new.groupBy(self.key).agg(*[F.min_by(c, F.struct(*[x for x in names if x != self.key])).alias(c) for c in names if c != self.key]).select(*names)
        kept = old.filter(F.coalesce(keep, F.lit(False))) if keep is not None else old
        a, b = kept.withColumn("_old", F.lit(True)), first.withColumn("_new", F.lit(True)).withColumnsRenamed({c: f"_{c}" for c in names if c != self.key})
        both = a.hint("merge").join(b, self.key, "full").select(self.key, *[F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in names if c != self.key]).select(*names)
        where = f"{self.path}/generation={number + 1}"
        name = f"cache_{abs(hash(where)):x}"
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        files, at = self._files(where)
        files.delete(at, True)
        # Dealt by the buckets' own hash, so a bucket is written by the task that has read it.
        both.repartition(self.buckets, self.key).write.bucketBy(self.buckets, self.key).sortBy(self.key).option("path", where).format("parquet").saveAsTable(name)

    def clean(self) -> None:
        """Deletes generations before the current one."""
        files, at = self._files(f"{self.path}/generation=*")
        for s in files.globStatus(at) or []:
            if int(str(s.getPath().getName()).split("=")[1]) < self.generation():
                files.delete(s.getPath(), True)
