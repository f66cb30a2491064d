"""Positions in a total order without one task that sees all rows.

Rows are dealt by ranges of the order and sorted within; a range's rows are numbered as they are written, and what stands before a range is added
by a small join. The written table makes a range's bounds the same for counting and for reading, whichever executors are lost meanwhile.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagehand.session import written

#: ``monotonically_increasing_id`` has the row within its partition in so many bits.
ROW_BITS = 33


def numbered(rows: DataFrame, *order: Column | str, name: str = "idx", first: int = 0, partitions: int | None = None) -> DataFrame:
    """Adds ``name``: each row's place from ``first`` in the order of ``order``, what ``row_number`` gives over all rows.

    Rows that are equal in ``order`` are ordered by a hash of the row, so that many equal ones don't meet in one range; only rows
    that are equal throughout stay together. The driver holds a count for each range.
    """
    spark = rows.sparkSession
    keys = [*order, F.xxhash64(*[c if t != "variant" else F.to_json(c) for c, t in _hashable(rows)])]
    dealt = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    at = F.monotonically_increasing_id()
    placed = written(dealt.sortWithinPartitions(*keys).withColumns({"_range": F.shiftright(at, ROW_BITS), "_row": at.bitwiseAND(F.lit((1 << ROW_BITS) - 1))}), "numbered")
    counts = sorted((r["_range"], r["n"]) for r in placed.groupBy("_range").agg(F.count("*").alias("n")).collect())
    before = accumulate((n for _, n in counts), initial=first)
    offsets = spark.createDataFrame([(k, b) for (k, _), b in zip(counts, before)], "_range bigint, _before bigint")
    out = placed.join(F.broadcast(offsets), "_range")  # a row a range
    return out.select(*rows.columns, (F.col("_before") + F.col("_row")).alias(name))


def _hashable(rows: DataFrame) -> list[tuple[Column, str]]:
    """Columns that can be hashed: maps as their entries."""
    return [(F.map_entries(f"`{f.name}`") if f.dataType.typeName() == "map" else F.col(f"`{f.name}`"), f.dataType.typeName()) for f in rows.schema]
