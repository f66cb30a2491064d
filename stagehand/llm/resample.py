"""Importance resampling towards a target distribution, over hashed runs of words.

Every run of 1 to ``order`` words falls in the bucket of its CRC-32. A word's CRC is computed
once, where it stands; that of a longer run follows by the algebra of CRCs: the CRC of AB is the
CRC of A shifted by the length of B, a linear map over GF(2), plus (xor) the CRC of B. The maps
for 1, 2, 4, ... bytes are kept as tables, and a length is shifted by those of its binary digits,
so no run's text is ever put together.

Two passes read the texts: one counts buckets (each task sends one row a bucket), the other turns
the buckets' gains into weights. All that goes to every task is the gains, ``buckets`` integers.
The draw ranks scores by their histogram (a score is bounded, so there are some 10**5 of them at
most) and by id among equal scores, without a total order in one task.

Defined cases: null and empty texts have no features, weight 0; a null id is hashed as an empty
one and comes last among equal scores; rows that repeat an id are drawn each; extra columns are
ignored, whatever their names; very long texts are taken whole; an empty target or source table
counts as no features; no rows give no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .tokens import LETTERED, LOWER, Words, pieces, words

BYTES = np.array([zlib.crc32(bytes([b])) for b in range(256)], dtype=np.uint32)
#: Step of the table-driven CRC, without the inversions at its ends.
STEP = BYTES[np.arange(256) ^ 255] ^ np.uint32(0xFF000000)
#: Words longer than this have their CRC computed one by one.
SHORT = 48


def _tables() -> np.ndarray:
    """For each power of two of bytes, the shift by so many zero bytes: a table for each byte of a CRC."""
    unit = np.uint32(1) << np.arange(32, dtype=np.uint32)
    column = (unit >> np.uint32(8)) ^ STEP[unit & np.uint32(255)]  # where each bit goes
    out = np.zeros((40, 4, 256), dtype=np.uint32)
    for power in range(40):
        for byte in range(4):
            for bit in range(8):
                set_ = (np.arange(256) >> bit & 1).astype(bool)
                out[power, byte, set_] ^= column[8 * byte + bit]
        column = _through(out[power], column)
    return out


def _through(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


SHIFT = _tables()


def shifted(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRCs after so many more zero bytes each, the linear part of appending a text of that length."""
    out = crc.copy()
    for power in range(int(lengths.max(initial=0)).bit_length()):
        on = np.flatnonzero(lengths >> power & 1)
        out[on] = _through(SHIFT[power], out[on])
    return out


def word_crcs(w: Words) -> np.ndarray:
    """CRC-32 of each word, A-Z lower-cased, byte by byte for all words at a time."""
    lengths = w.ends - w.starts
    order = np.argsort(-np.minimum(lengths, SHORT), kind="stable")
    left = np.minimum(lengths, SHORT)[order]
    at, crc = w.starts[order], np.full(len(order), 0xFFFFFFFF, dtype=np.uint32)
    for k in range(int(left.max(initial=0))):
        n = np.searchsorted(-left, -k)  # the words that have a byte k come first
        crc[:n] = (crc[:n] >> np.uint32(8)) ^ STEP[(crc[:n] ^ LOWER[w.data[at[:n] + k]]) & np.uint32(255)]
    out = np.empty_like(crc)
    out[order] = ~crc
    for i in np.flatnonzero(lengths > SHORT):
        out[i] = zlib.crc32(LOWER[w.data[w.starts[i] : w.ends[i]]].tobytes())
    return out


def features(w: Words, order: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of one, two ... words: the bucket of each and the row of its text."""
    row = np.repeat(np.arange(len(w.count)), w.count)
    lengths, word = w.ends - w.starts, word_crcs(w)
    crc = word
    for n in range(1, order + 1):
        if n > 1:
            spaced = _through(SHIFT[0], crc[:-1]) ^ BYTES[32]
            crc = shifted(spaced, lengths[n - 1 :]) ^ word[n - 1 :]
        whole = row[n - 1 :] == row[: len(row) - n + 1]
        yield crc[whole] % np.uint32(buckets), row[n - 1 :][whole]
        if len(crc) < 2:
            return


def histogram(texts: DataFrame, order: int, buckets: int) -> np.ndarray:
    """How many features of a table's ``text`` fall in each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for _, _, data, offsets in pieces(b.column(0)):
                for bucket, _ in features(words(data, offsets, LETTERED), order, buckets):
                    total += np.bincount(bucket, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], ["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for r in texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(share of the target / share of the source)) of each bucket, one count added to each."""
    m, s, t = float(len(source)), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(y) + 1) * (s + m) / ((float(x) + 1) * (t + m)))) for x, y in zip(source, target)], dtype=np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, order: int) -> DataFrame:
    """(``doc_id``, ``n_words``, ``n_features``, ``weight``) of each document."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n, total = (np.zeros(b.num_rows, dtype=np.int64) for _ in range(3))
            for at, to, data, offsets in pieces(b.column(1)):
                w = words(data, offsets, LETTERED)
                n_words[at:to] = w.count
                for bucket, row in features(w, order, len(gain)):
                    many = np.bincount(row, minlength=to - at)
                    sums = np.concatenate([[0], np.cumsum(gain[bucket])])
                    ends = np.cumsum(many)
                    n[at:to] += many
                    total[at:to] += sums[ends] - sums[ends - many]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x) for x in (n_words, n, np.where(n > 0, total // np.maximum(n, 1), 0)))], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, order: int = 2, buckets: int = 10_000, seed: str = "7", least: int = 20, percent: int = 25) -> DataFrame:
    """(``doc_id``, ``n_features``, ``weight``, ``score``, ``rank``): a draw without replacement, by Gumbel noise on log weights.

    ``percent`` of the documents of ``least`` words are drawn, the highest scores.
    """
    gain = gains(histogram(docs, order, buckets), histogram(target, order, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = cut(weighed(docs, gain, order).withColumn("score", F.col("weight") + noise))
    able = scored.filter(F.col("n_words") >= least)
    counts = able.groupBy("score").agg(F.count("*").alias("_n"))
    above = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(F.col("score"), F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_before"))
    many = able.count() * percent // 100
    inside = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight")
    placed = able.join(before, "score").withColumn("rank", F.col("_before") + F.row_number().over(inside))
    out = placed.withColumn("rank", F.when(F.col("rank") <= many, F.col("rank"))).unionByName(scored.filter(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long")), allowMissingColumns=True)
    return out.select("doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))
