"""Judgements remembered in keyed state: a key is judged again only once it went unseen for a time.

The state of a key is the verdict and when the key was last seen; a timer at that time plus ``ttl`` takes it away as the watermark passes,
so the state holds the keys of the last ``ttl`` and no folder of old verdicts is read again. Whether a row is a hit is told by its own
time, not by when the timer fires, so batches of any size give the rows of ``remembered_batch``, as long as no batch brings rows older
than the watermark or than rows of its key in batches before.

A batch's rows of one key are put in order in the task that holds the key; the size of triggers bounds them. State lives in RocksDB and in the
checkpoint folder, and so outlives executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "verdict string, seen_us bigint"


class Memory(StatefulProcessor):
    """``judge`` gives the verdict on a row; ``at`` names its time, ``order`` what orders rows of equal times."""

    def __init__(self, judge: Callable[[Any], str], keys: list[str], at: str, order: str, ttl_us: int):
        self.judge, self.keys, self.at, self.order, self.ttl = judge, keys, at, order, ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.memo = handle.getValueState("memo", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values([self.at, self.order], kind="stable")
        held = self.memo.get() if self.memo.exists() else None
        verdict, seen = held or (None, None)
        micros = frame[self.at].astype("datetime64[us]").astype("int64")
        out = []
        for row, now in zip(frame.itertuples(index=False), micros):
            judged = seen is None or now - seen > self.ttl
            verdict = self.judge(row) if judged else verdict
            seen = now if seen is None else max(seen, now)
            out.append((*key, getattr(row, self.order), now, verdict, judged))
        self.memo.update((verdict, int(seen)))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((int(seen) + self.ttl) // 1000 + 1)
        yield pd.DataFrame(out, columns=[*self.keys, self.order, "at_us", "verdict", "judged"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.memo.clear()
        return iter(())

    def close(self) -> None:
        pass


def _schema(rows: DataFrame, keys: list[str], order: str) -> str:
    of = {f.name: f.dataType.simpleString() for f in rows.schema}
    return ", ".join([*(f"`{c}` {of[c]}" for c in (*keys, order)), "at_us bigint, verdict string, judged boolean"])


def remembered(stream: DataFrame, keys: list[str], at: str, order: str, judge: Callable[[Any], str], ttl: int, late: str = "0 seconds") -> DataFrame:
    """(keys, ``order``, ``at_us``, ``verdict``, ``judged``) of each row of a stream; ``ttl`` in seconds."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    processor = Memory(judge, keys, at, order, ttl * 1_000_000)
    return stream.withWatermark(at, late).groupBy(*keys).transformWithStateInPandas(statefulProcessor=processor, outputStructType=_schema(stream, keys, order), outputMode="Append", timeMode="EventTime")


def remembered_batch(rows: DataFrame, keys: list[str], at: str, order: str, verdict, ttl: int) -> DataFrame:
    """The same of a table, by windows: ``verdict`` is a Column of the row that is judged."""
    run = Window.partitionBy(*keys).orderBy(at, order)
    micros = F.unix_micros(at)
    marked = rows.withColumn("at_us", micros).withColumn("judged", F.coalesce(micros - F.lag(micros).over(run) > ttl * 1_000_000, F.lit(True)))
    return marked.withColumn("verdict", F.last(F.when(F.col("judged"), verdict), ignorenulls=True).over(run)).select(*keys, order, "at_us", "verdict", "judged")


def held(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(``key``, ``verdict``, ``seen_us``) of what a stopped stream remembers."""
    return spark.read.format("statestore").option("stateVarName", "memo").load(checkpoint).select("key", "value.*")


def replay(rows: DataFrame, at: str, folder: str, slices: int) -> DataFrame:
    """A table as a stream that brings ``slices`` equal spans of time, one file after another in the order of time."""
    spark = rows.sparkSession
    first, last = rows.agg(F.min(F.unix_micros(at)), F.max(F.unix_micros(at))).first()
    if first is not None:
        slot = F.least(F.floor((F.unix_micros(at) - first) * slices / (last - first + 1)), F.lit(slices - 1))
        for k in range(slices):
            rows.filter(slot == k).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
