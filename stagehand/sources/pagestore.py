"""Stored pages as a Spark data source, ``stagehand_pages``: a folder of batches, each a folder for every host.

``store`` adds a batch with Spark's own Parquet writer; a batch counts once it is whole, so readers never see
half of one, and writing a number again replaces it. ``register`` makes ``spark.read`` and ``spark.readStream`` know the format:

    pagestore.read(spark, path).filter("host = 'a.org' and fetched_at > '2026-09-01'")

Filters on ``host`` and ``batch`` choose folders, so the others aren't even listed; those on ``fetched_at`` skip row groups by their
statistics, and Spark checks them again. Spark 4.1 keeps the filters last pushed to a relation for a later plan that pushes none, so ``read``
always pushes one that holds everywhere (``batch >= 0``); with ``spark.read.format`` alone, load the path anew for each query. A task reads the files of hosts up to ``split`` bytes: one host at least, and a host
of more than that is read by several tasks. A stream's offset is a batch number; each trigger reads the batches after the last one.

Null urls have a null host. Stored times are microseconds of UTC. The folder must be one that the workers' Python can open (a mounted folder, or
a store that Arrow knows).
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator, Sequence
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from stagehand.sources.probes import root

PAGE = "batch int, host string, url string, rendered boolean, final_url string, status int, body string, error string, fetched_at timestamp"
FORMAT = "stagehand_pages"
SPLIT = 128 << 20
NO_HOST = "__HIVE_DEFAULT_PARTITION__"
COMPARED = {GreaterThan: "__gt__", GreaterThanOrEqual: "__ge__", LessThan: "__lt__", LessThanOrEqual: "__le__", EqualTo: "__eq__"}


def host_of(url):
    """The host of a url, without its scheme."""
    return F.nullif(F.regexp_replace(root(url), "^[a-z]+://", ""), F.lit(""))


def store(pages: DataFrame, path: str, number: int | None = None) -> int:
    """Adds fetched pages (as ``fetching.fetch`` gives them) as batch ``number``, the next one unless given; gives its number.

    Rows are dealt by ranges of host and url, so a host of any size is written by as many tasks as its share needs, and others lie in one file or two.
    """
    spark = pages.sparkSession
    if number is None:
        number = 1 + max(_batches(*_opened(_address(spark, path))), default=-1)
    rows = pages.select(host_of(F.col("url")).alias("host"), *[c.split()[0] for c in PAGE.split(", ")[2:-1]], F.unix_micros("fetched_at").alias("fetched_us"))
    rows.repartitionByRange("host", "url").sortWithinPartitions("host", "fetched_us").write.mode("overwrite").partitionBy("host").parquet(f"{path.rstrip('/')}/batch={number}")
    return number


def register(spark: SparkSession) -> None:
    spark.dataSource.register(StoredPages)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format(FORMAT).load(_address(spark, path)).filter("batch >= 0")


def stream(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.readStream.format(FORMAT).load(_address(spark, path))


def _address(spark: SparkSession, path: str) -> str:
    """A path with its scheme, as Spark understands it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    files, at = fs.FileSystem.from_uri("file://" + path.removeprefix("file:").removeprefix("//") if path.startswith("file:") else path)
    return files, at.rstrip("/")


def _batches(files: fs.FileSystem, at: str) -> list[int]:
    """Numbers of the whole batches."""
    found = [i.base_name.removeprefix("batch=") for i in files.get_file_info(fs.FileSelector(at, allow_not_found=True)) if i.base_name.startswith("batch=")]
    whole = files.get_file_info([f"{at}/batch={n}/_SUCCESS" for n in found])
    return sorted(int(n) for n, i in zip(found, whole) if i.type == fs.FileType.File)


class Part(InputPartition):
    """Files of hosts: (batch, host, path)."""

    def __init__(self, found: list[tuple[int, str | None, str]]):
        self.found = found


def _parts(path: str, split: int, hosts: set[str] | None, after: int, upto: int | None) -> list[Part]:
    """The files of the wanted hosts in batches after one number up to another, in parts of about ``split`` bytes."""
    files, at = _opened(path)
    found: dict[str, list[tuple[int, fs.FileInfo]]] = {}
    for n in _batches(files, at):
        if n > after and (upto is None or n <= upto):
            folder = f"{at}/batch={n}"
            folders = [i.path for i in files.get_file_info(fs.FileSelector(folder)) if i.base_name.startswith("host=")]
            for where in folders:
                host = where.rsplit("/host=", 1)[1]
                if hosts is None or unquote(host) in hosts:
                    found.setdefault(host, []).extend((n, i) for i in files.get_file_info(fs.FileSelector(where)) if i.path.endswith(".parquet"))
    parts, held, size = [], [], 0
    for host in sorted(found):
        for n, i in found[host]:
            if held and size + i.size > split:
                parts.append(Part(held))
                held, size = [], 0
            held.append((n, None if host == NO_HOST else unquote(host), i.path))
            size += i.size
    return [*parts, Part(held)] if held else parts


def _rows(path: str, part: Part, condition: ds.Expression | None) -> Iterator[pa.RecordBatch]:
    files, _ = _opened(path)
    names = [c.split()[0] for c in PAGE.split(", ")]
    for n, host, where in part.found:
        for b in ds.dataset(where, filesystem=files, format="parquet").to_batches(filter=condition, columns=[*names[2:-1], "fetched_us"]):
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([n] * b.num_rows, pa.int32()), pa.array([host] * b.num_rows, pa.string()), *b.columns[:-1], b.column(b.num_columns - 1).cast(pa.timestamp("us", tz="UTC"))], names)


def micros(time: datetime.datetime) -> int:
    """Microseconds since 1970; a time without a zone is UTC."""
    aware = time if time.tzinfo else time.replace(tzinfo=datetime.UTC)
    return (aware - datetime.datetime(1970, 1, 1, tzinfo=datetime.UTC)) // datetime.timedelta(microseconds=1)


class Reader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split
        self.hosts: set[str] | None = None
        self.times: list[tuple[str, int]] = []
        self.first, self.last = 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equalities of ``host`` and bounds of ``batch`` wholly; those of ``fetched_at`` narrow the scan and are checked again."""
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("host",) and isinstance(f, EqualTo | In):
                said = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.hosts = said if self.hosts is None else self.hosts & said
            elif column == ("batch",) and isinstance(f, IsNotNull):
                continue  # every row has one
            elif column == ("batch",) and isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.first = max(self.first, f.value + isinstance(f, GreaterThan))
            elif column == ("batch",) and isinstance(f, LessThan | LessThanOrEqual):
                self.last = min(x for x in (self.last, f.value - isinstance(f, LessThan)) if x is not None)
            else:
                if column == ("fetched_at",) and type(f) in COMPARED and isinstance(f.value, datetime.datetime):
                    self.times.append((COMPARED[type(f)], micros(f.value)))
                yield f

    def partitions(self) -> Sequence[Part]:
        return _parts(self.path, self.split, self.hosts, self.first - 1, self.last) or [Part([])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        condition = None
        for way, time in self.times:
            one = getattr(ds.field("fetched_us"), way)(time)
            condition = one if condition is None else condition & one
        return _rows(self.path, partition, condition)


class StreamReader(DataSourceStreamReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def initialOffset(self) -> dict:
        return {"batch": -1}

    def latestOffset(self) -> dict:
        return {"batch": max(_batches(*_opened(self.path)), default=-1)}

    def partitions(self, start: dict, end: dict) -> Sequence[Part]:
        return _parts(self.path, self.split, None, start["batch"], end["batch"]) or [Part([])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return _rows(self.path, partition, None)


class StoredPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return PAGE

    def _of(self) -> tuple[str, int]:
        if "path" not in self.options:
            raise ValueError("stored pages need a path")
        return self.options["path"], int(self.options.get("split", SPLIT))

    def reader(self, schema) -> Reader:
        return Reader(*self._of())

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(*self._of())
