"""Packing into optimal length buckets with token-budget batches.

The lengths of all rows are counted into one histogram. Dynamic programming over it
chooses the bucket boundaries with the least padding in all. Inside a bucket the
rows stand in a shuffled, repeatable order and are cut into batches of as many rows
as the token budget holds at the bucket's length.

The histogram has a row for each length that occurs, up to 2**20 tokens, and 2**19 bins
for each doubling above (a bin keeps its largest length, its rows and its tokens), where
the boundaries may add 2e-6 of a text's length to its padding. So the driver gets a row
for each length, not for each text: some tens of thousands for texts of up to 20,000
words, and a million or two however large the table and the texts are. Row positions in a bucket come
from a sharded running count, so a bucket may hold any share of the rows.

Defined cases: a null or empty text has the length 0 and goes to the first bucket;
a row longer than the budget is a batch by itself; equal rows keep separate places;
an empty table gives an empty one. Input columns that clash with the output are replaced.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, n_words, order_key, running_total, shards_for

EXACT_BITS = 20
OUT = ("n_tokens", "bucket", "bucket_len", "batch", "slot", "padding")


def bin_of(length: Column) -> Column:
    """The histogram bin: the length itself up to 2**20, then its 20 leading bits."""
    bits = F.length(F.bin(length))
    step = F.greatest(bits - EXACT_BITS, F.lit(0))
    unit = F.pow(F.lit(2.0), step)
    return (F.floor(length / unit) * unit).cast("long")


def boundaries(histogram: list[tuple[int, int, int]], buckets: int) -> list[int]:
    """The bucket lengths with the least padding; ``histogram``: (largest length, rows, tokens), ascending.

    The cost of a bucket over bins j..i-1 is length(i-1) * (rows up to i - rows up to j)
    minus its tokens. For a fixed number of buckets it is a minimum of lines in
    length(i-1) with falling slopes, so a hull of lines answers each step in O(1).
    """
    n = len(histogram)
    if n <= buckets:
        return [x for x, _, _ in histogram]
    rows = [0]
    for _, r, _ in histogram:
        rows.append(rows[-1] + r)
    cost = [0] + [None] * n
    came: list[list[int]] = []
    for _ in range(buckets):
        hull: deque[tuple[int, int, int]] = deque()  # slope, intercept, j
        step, froms = [None] * (n + 1), [0] * (n + 1)
        for i in range(1, n + 1):
            j = i - 1
            if cost[j] is not None:
                slope, at = -rows[j], cost[j]
                while len(hull) > 1 and (at - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - slope):
                    hull.pop()
                if hull and hull[-1][0] == slope:
                    if hull[-1][1] <= at:
                        slope = None
                    else:
                        hull.pop()
                if slope is not None:
                    hull.append((slope, at, j))
            x = histogram[i - 1][0]
            while len(hull) > 1 and hull[1][0] * x + hull[1][1] <= hull[0][0] * x + hull[0][1]:
                hull.popleft()
            if hull:
                step[i], froms[i] = hull[0][0] * x + hull[0][1] + x * rows[i], hull[0][2]
        came.append(froms)
        cost = step
    out, i = [], n
    for froms in reversed(came):
        out.append(histogram[i - 1][0])
        i = froms[i]
    return out[::-1]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), buckets: int = 12, budget: int = 16_384, length: Column | None = None) -> DataFrame:
    """Packs every row; returns the id, ``keep`` and ``OUT``.

    ``length``: a row's tokens, the words of its text if none is given.
    ``batch`` is the bucket's number and the batch's place in it; ``slot`` the row's place in the batch.
    """
    keep = tuple(c for c in keep if c not in OUT)
    measured = cut(
        docs.select(
            id_col, *keep,
            (n_words(F.col(text_col)) if length is None else F.coalesce(length, F.lit(0)).cast("long")).alias("n_tokens"),
            order_key("pack", F.col(id_col), F.col(text_col)).alias("_key"),
        )
    )
    counted = measured.groupBy(bin_of(F.col("n_tokens")).alias("_bin")).agg(F.max("n_tokens").alias("top"), F.count("*").alias("rows"), F.sum("n_tokens").alias("tokens"))
    histogram = sorted((r["top"], r["rows"], r["tokens"]) for r in counted.collect())
    rows = sum(r for _, r, _ in histogram)
    ends = boundaries(histogram, buckets) or [0]
    edges = F.array(*[F.lit(e).cast("long") for e in ends])
    bucket = F.size(F.filter(edges, lambda e: e < F.col("n_tokens")))
    placed = measured.withColumn("bucket", bucket)
    placed = running_total(placed, "bucket", "_key", F.lit(1), shards_for(rows), "_place", peers=False)
    placed = placed.withColumn("bucket_len", F.element_at(edges, F.col("bucket") + 1)).withColumn("_place", F.col("_place") - 1)
    holds = F.greatest(F.floor(F.lit(budget) / F.greatest(F.col("bucket_len"), F.lit(1))), F.lit(1))
    return placed.select(
        id_col, *keep, "n_tokens", "bucket", "bucket_len",
        F.concat_ws("-", F.col("bucket").cast("string"), F.floor(F.col("_place") / holds).cast("string")).alias("batch"),
        (F.col("_place") % holds).cast("long").alias("slot"),
        (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
    )
