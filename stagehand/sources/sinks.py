"""Snapshots, guarded writes and the page with its events inside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagehand.operators import numbering
from stagehand.operators.snapshots import shrink_reason

PLACEHOLDER = "/*__EVENTS__*/[]"


class Refused(RuntimeError):
    """A write that would lose too much of the last snapshot."""


def save(rows: DataFrame, path: str, generated: str) -> None:
    """A dated snapshot; writing a date again replaces that date alone."""
    rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/generated={generated}")


def before(spark: SparkSession, path: str, generated: str) -> DataFrame | None:
    """The last snapshot dated before ``generated``, or None. Only folders of dates are looked at."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/generated=*")
    found = [str(s.getPath()) for s in at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []]
    older = [f for f in found if f.rsplit("=", 1)[1] < generated]
    return spark.read.parquet(max(older, key=lambda f: f.rsplit("=", 1)[1])) if older else None


def guarded_save(rows: DataFrame, path: str, generated: str, key: str, exempt: DataFrame | None = None, force: bool = False) -> None:
    """``save``, but ``Refused`` if rows shrank by half or a key that isn't ``exempt`` vanished."""
    old = before(rows.sparkSession, path, generated)
    if old is not None and not force:
        reason = shrink_reason(old, rows, key, exempt).first()["reason"]
        if reason:
            raise Refused(reason)
    save(rows, path, generated)


def artifact(events: DataFrame, venues: DataFrame, template: str, order: list[str]) -> DataFrame:
    """One row (page): the template with the events put in as JSON, numbered in ``order``, with their venue's name and area.

    The page is one text for a reader's browser, so it holds a weekly extract, not a corpus.
    """
    if PLACEHOLDER not in template:
        raise ValueError(f"placeholder {PLACEHOLDER!r} not found")
    meta = venues.select(F.col("id").alias("venue_id"), F.col("name").alias("_name"), F.col("area").alias("_area"))
    numbered = numbering.numbered(events, *order, name="_n").join(meta, "venue_id", "left")
    row = F.struct(*events.columns, F.format_string("e%03d", "_n").alias("id"), F.coalesce("_name", "venue_id").alias("venue_name"), F.coalesce("_area", F.lit("")).alias("venue_area"))
    body = F.array_sort(F.collect_list(F.struct("_n", F.to_json(row, {"ignoreNullFields": "false"}).alias("j"))))
    inside = F.concat(F.lit("["), F.array_join(F.transform(body, lambda r: r["j"]), ", "), F.lit("]"))
    return numbered.agg(F.replace(F.lit(template), F.lit(PLACEHOLDER), inside).alias("page"))


def swap(rows: DataFrame, path: str) -> None:
    """Replaces the table at ``path``, which ``rows`` may read: written beside it first, then moved in its place."""
    spark, new, old = rows.sparkSession, f"{path.rstrip('/')}.new", f"{path.rstrip('/')}.old"
    rows.write.mode("overwrite").parquet(new)
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    files = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(at(old), True)
    if files.exists(at(path)):
        files.rename(at(path), at(old))
    files.rename(at(new), at(path))
    files.delete(at(old), True)


def read_or(empty: DataFrame, path: str) -> DataFrame:
    """The table at ``path`` with the schema of ``empty``; ``empty`` if there is no whole table."""
    spark = empty.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    return spark.read.schema(empty.schema).parquet(path) if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else empty


def envelope(records: DataFrame, start, end, generated) -> DataFrame:
    """One row (window, generated, count) that goes beside a snapshot."""
    return records.agg(F.array(F.lit(start), F.lit(end)).alias("window"), F.lit(generated).alias("generated"), F.count("*").alias("count"))


def as_json(rows: DataFrame, path: str) -> None:
    """Lines of JSON, null fields too: probes, validations and maps of urls."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
