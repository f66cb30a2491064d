"""Windows, first-seen rows and memoised judgements over streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    """A folder of Parquet files as a stream. ``ts`` without a zone becomes a UTC timestamp, which watermarks need."""
    stream = spark.readStream.schema(schema).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, width: str = "1 day", slide: str | None = None, late: str = "1 day", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts and sums for each window and group; rows later than ``late`` are left out of a stream. A batch gives all windows."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    grouped = events.withWatermark("ts", late).groupBy(window.alias("w"), *by)
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day", by: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """Counts for each session: rows of a group less than ``gap`` apart."""
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), *by)
    return grouped.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def first_seen(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """One row of each key while the key is remembered, which is ``late`` at least."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def memoised(stream: DataFrame, key: str, path: str, judge: Callable[[DataFrame], DataFrame], checkpoint: str):
    """Starts a stream that judges only keys not yet in the table at ``path``.

    Each batch writes its own folder by batch id, replacing what a failed try of the same
    batch left, so a replayed batch adds nothing twice.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        new = rows.dropDuplicates([key])
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/batch=*/_SUCCESS")
        if len(done.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(done)):
            known = spark.read.parquet(path).filter(F.col("batch") < number)
            new = new.join(known.select(key), key, "left_anti")
        judge(new).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
