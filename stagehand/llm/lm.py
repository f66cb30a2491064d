"""Interpolated modified Kneser-Ney n-gram model: counted in Spark, kept as sorted hash arrays, mapped by workers.

A text is its words and one end, after ``order - 1`` start marks. The model is made one order after
another. Words are counted first; a word's id is its place among the sorted hashes of all words. Each
task then turns its texts into ids, counts its distinct n-grams of the highest order, and deals them by
hash range into shards; a shard's task sums them, and writes sorted arrays: hash and count. Of each distinct
n-gram it sends on its last words (whose number of distinct predecessors is what the next lower order counts) and
what its context needs: the sum of counts, and how many of them are 1, 2 and more. A hot word or context is thus one
row for each shard and task, however often it occurs, and no shard holds more than its hash range.

Arrays are NumPy files in the shared folder of the session (``spark.checkpoint.dir``), which must be mounted by all
workers, as nothing but the operating system's page cache is to hold them; a task writes them under a name of its own and
renames them, so that a task that runs again does no harm. Scoring maps them, sorts the hashes that a run of
texts asks for, and so reads each array in order. Nothing of the model goes through the driver but sizes and totals.

p(w | c) = max(a(cw) - D, 0) / A(c) + (D1 n1(c) + D2 n2(c) + D3 n3(c)) / A(c) * p(w | shorter c), with counts
a at the highest order and numbers of distinct predecessors below; a context that wasn't seen leaves it to the shorter one; the last
one is uniform over all distinct tokens and one unknown. D comes from the numbers of n-grams counted 1 to 4 times (0.5, 1 and 1.5 where those are too few).

Words are told apart by 64-bit hashes, so two of a billion fall together with a probability of some 3 %.

Defined cases: null and empty texts are one end; a text is scored whole, in slices if long; repeated rows count and are
scored each; rows whose ``train`` is null aren't learned from; without training rows every token has probability 1; extra
columns are ignored, whatever their names; no rows give no rows.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _at, cut, scratch_dir
from .tokens import SPACED, U, mix, pieces, words

START, END, WORDS = 0, 1, 2
UNKNOWN = (1 << 64) - 1
#: Tokens that are counted or scored at a time.
SLICE = 1 << 18
#: N-grams that a task holds before it sends their counts.
HELD = 1 << 20
#: Bytes of texts that are read at a time.
PIECE = 1 << 20
#: Counts up to this are kept in a byte.
BYTE = 254
BLOBS = "kind int, shard int, n long, data binary"
MADE = "kind int, shard int, n long, data binary, total long, n1 long, n2 long, n3 long, n4 long, more long"
NGRAMS, CONTEXTS, SUMS = 0, 1, 2


class Model(NamedTuple):
    """``sizes[n]``: entries of each shard at order n, 0 being the words. ``totals[n]``: sum of counts, and numbers of n-grams counted 1, 2 and 3 or more times."""

    folder: str
    order: int
    shards: int
    sizes: dict[int, list[int]]
    discounts: dict[int, list[float]]
    totals: dict[int, list[int]]
    tokens: int
    ends: int

    @property
    def distinct(self) -> int:
        """Distinct training tokens, the end among them."""
        return sum(self.sizes[0]) + (self.ends > 0)


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """The equal range of 64-bit hashes that each falls in."""
    return ((hashes >> U(32)) * U(shards) >> U(32)).astype(np.int64)


def chained(columns: list[np.ndarray]) -> np.ndarray:
    """The hash of each row of ids."""
    h = np.full(len(columns[0]), len(columns), dtype=U)
    for c in columns:
        h = mix(h * U(3) + mix(c + U(0x9E3779B97F4A7C15)))
    return h


def packed(columns: list[np.ndarray]) -> bytes:
    """Columns as planes of bytes, lowest first, as many as the largest value needs; each plane's bytes are alike and so compress."""
    widths = [max(1, -(-int(c.max(initial=0)).bit_length() // 8)) for c in columns]
    planes = (np.ascontiguousarray(c.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :w].T.tobytes() for c, w in zip(columns, widths))
    return bytes([len(columns), *widths]) + b"".join(planes)


def unpacked(data: bytes, n: int) -> list[np.ndarray]:
    out, at = [], 1 + data[0]
    for w in data[1:at]:
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :w] = np.frombuffer(data, np.uint8, w * n, at).reshape(w, n).T
        out.append(wide.view("<u8").ravel())
        at += w * n
    return out


def merged(columns: list[np.ndarray], values: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct rows of ids in order, with the sums of their values."""
    if len(columns[0]) == 0:
        return columns, values
    if len(columns) == 2 and max(int(c.max()) for c in columns) < 1 << 32:
        order = np.argsort(columns[0] << U(32) | columns[1])
    else:
        order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.zeros(len(order), dtype=bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    at = np.flatnonzero(new)
    return [c[at] for c in columns], [np.add.reduceat(v[order], at) for v in values]


def dealt(kind: int, columns: list[np.ndarray], values: list[np.ndarray], hashes: np.ndarray, shards: int) -> Iterator[tuple[int, int, int, bytes]]:
    """A row for each shard that some rows of ids belong to."""
    shard = shard_of(hashes, shards).astype(np.uint16 if shards <= 1 << 16 else np.int64)
    order = np.argsort(shard, kind="stable")
    ends = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(ends)):
        here = order[ends[s] : ends[s + 1]]
        yield kind, int(s), len(here), packed([c[here] for c in [*columns, *values]])


def table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, (_, t) in enumerate(names)], [n for n, _ in names])


def mounted(folder: str) -> str:
    """The path at which workers find the shared folder."""
    url = urlparse(folder)
    if url.scheme not in ("", "file"):
        raise RuntimeError(f"a model is memory-mapped, so spark.checkpoint.dir must be a mounted folder, not {folder}")
    return url.path


def save(path: str, array: np.ndarray) -> None:
    """Writes a file that is there whole or not at all."""
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        np.save(f, array)
    os.replace(part, path)


def save_counts(folder: str, name: str, hashes: np.ndarray, counts: np.ndarray) -> None:
    """Sorted hashes, their counts in a byte, and the places and values of larger counts."""
    order = np.argsort(hashes)
    counts = counts[order].astype(np.int64)
    large = np.flatnonzero(counts > BYTE)
    save(f"{folder}/{name}.key.npy", hashes[order])
    save(f"{folder}/{name}.count.npy", np.minimum(counts, BYTE + 1).astype(np.uint8))
    save(f"{folder}/{name}.large.npy", np.stack([large, counts[large]]))


class Mapped:
    """The arrays of a model, as this process has mapped them."""

    def __init__(self, model: Model):
        self.model, self.files = model, {}
        self.before = np.concatenate([[0], np.cumsum(model.sizes[0])])

    def file(self, name: str) -> np.ndarray:
        if name not in self.files:
            self.files[name] = np.load(f"{self.model.folder}/{name}.npy", mmap_mode="r")
        return self.files[name]

    def _each(self, hashes: np.ndarray, name: str, there: list[int]) -> Iterator[tuple[int, slice, np.ndarray, np.ndarray]]:
        """For sorted hashes, shard by shard: the shard, which of them fall in it, their places in its array, and which of them it holds."""
        ends = np.searchsorted(shard_of(hashes, self.model.shards), np.arange(self.model.shards + 1))
        for s in np.flatnonzero(np.diff(ends)):
            if there[s]:
                keys, here = self.file(f"{name}-{s}.key"), slice(ends[s], ends[s + 1])
                at = np.minimum(np.searchsorted(keys, hashes[here]), len(keys) - 1)
                yield int(s), here, at, keys[at] == hashes[here]

    def counts(self, n: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The count of each n-gram, and its place among all of its order (-1: none)."""
        asked, back = np.unique(hashes, return_inverse=True)
        count, place = np.zeros(len(asked), np.int64), np.full(len(asked), -1, np.int64)
        for s, here, at, found in self._each(asked, str(n), self.model.sizes[n]):
            c = self.file(f"{n}-{s}.count")[at].astype(np.int64)
            large = np.flatnonzero((c > BYTE) & found)
            if len(large):
                places, values = self.file(f"{n}-{s}.large")
                c[large] = values[np.searchsorted(places, at[large])]
            count[here] = np.where(found, c, 0)
            if n == 0:
                place[here] = np.where(found, at + self.before[s], -1)
        return count[back], place[back]

    def contexts(self, n: int, hashes: np.ndarray) -> list[np.ndarray]:
        """For the contexts of order n: the sum of counts, and how many are 1, 2 and more; 0 where the context is new."""
        asked, back = np.unique(hashes, return_inverse=True)
        out = np.zeros((4, len(asked)), np.int64)
        for s, here, at, found in self._each(asked, f"{n}c", [1] * self.model.shards):
            out[:, here] = np.where(found, self.file(f"{n}c-{s}.value")[:, at], 0)
        return list(out[:, back])


MAPPED: list[Mapped] = []


def mapped(model: Model) -> Mapped:
    """The model's arrays; a worker keeps those of one model open."""
    if not MAPPED or MAPPED[0].model != model:
        MAPPED[:] = [Mapped(model)]
    return MAPPED[0]


def sequence(ids: np.ndarray, count: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts one behind another, each after its start marks and before its end; where each text's first token stands."""
    long = count + order
    first = np.cumsum(long) - long + order - 1
    out = np.full(long.sum(), START, dtype=U)
    inside = np.ones(len(out), bool)
    inside[first + count] = False
    for k in range(1, order):
        inside[first - k] = False
    out[inside] = ids
    out[first + count] = END
    return out, first


def fit(docs: DataFrame, train: Column, order: int = 2, shards: int | None = None) -> Model:
    """Learns from the rows of ``docs`` (``text``) for which ``train`` holds."""
    spark: SparkSession = docs.sparkSession
    at = f"{scratch_dir(spark)}/lm-{uuid.uuid4().hex}"
    folder = mounted(at)
    os.makedirs(folder)
    files, path = _at(spark, at)
    files.deleteOnExit(path)
    texts = docs.filter(train).select(F.col("text").cast("string").alias("text"))
    ends, chars = texts.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    shards = shards or int(min(1 << 15, max(8, -(-chars // (1 << 23)))))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in _and_none(batches):
            for h in _hashes(b):
                held.append(h)
            if held and (b is None or sum(map(len, held)) >= HELD):
                keys, n = np.unique(np.concatenate(held), return_counts=True)
                yield table(list(dealt(NGRAMS, [keys], [n], keys, shards)), BLOBS)
                held = []

    def save_words(group: pa.Table) -> pa.Table:
        (keys,), (n,) = _gathered(group, 1)
        s = group.column("shard")[0].as_py()
        save_counts(folder, f"0-{s}", keys, n)
        return pa.Table.from_batches([table([(SUMS, s, len(keys), None, int(n.sum()), 0, 0, 0, 0, 0)], MADE)])

    made = texts.mapInArrow(count_words, BLOBS).groupBy("shard").applyInArrow(save_words, MADE).select("shard", "n", "total").collect()
    size = {r["shard"]: r["n"] for r in made}
    model = Model(folder, order, shards, {0: [size.get(s, 0) for s in range(shards)]}, {}, {}, sum(r["total"] for r in made) + ends, ends)

    def count_ngrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = mapped(model)
        held: list[list[np.ndarray]] = []
        for b in _and_none(batches):
            for seq, first, count in _sequences(b, arrays, order):
                for low in range(0, len(seq), SLICE):
                    p = np.arange(max(low, order - 1), min(low + SLICE, len(seq)))
                    p = p[_predicted(p, first, count)]
                    held.append([seq[p - k] for k in range(order - 1, -1, -1)])
            if held and (b is None or sum(len(x[0]) for x in held) >= HELD):
                columns = [np.concatenate(x) for x in zip(*held)]
                columns, values = merged(columns, [np.ones(len(columns[0]), np.int64)])
                yield table(list(dealt(NGRAMS, columns, values, chained(columns), shards)), BLOBS)
                held = []

    def save_ngrams(n: int):
        def run(group: pa.Table) -> pa.Table:
            columns, (count,) = _gathered(group, n)
            s = group.column("shard")[0].as_py()
            save_counts(folder, f"{n}-{s}", chained(columns), count)
            of = [int((count == k).sum()) for k in (1, 2, 3, 4)]
            rows = [(SUMS, s, len(count), None, int(count.sum()), *of, int((count > 2).sum()))]
            if n > 1:
                low, times = merged(columns[1:], [np.ones(len(count), np.int64)])
                rows += [(*r, 0, 0, 0, 0, 0, 0) for r in dealt(NGRAMS, low, times, chained(low), shards)]
                context, values = merged(columns[:-1], [count, *((count == k).astype(np.int64) for k in (1, 2)), (count > 2).astype(np.int64)])
                rows += [(*r, 0, 0, 0, 0, 0, 0) for r in dealt(CONTEXTS, context, values, chained(context), shards)]
            return pa.Table.from_batches([table(rows, MADE)])

        return run

    def save_contexts(n: int):
        def run(group: pa.Table) -> pa.Table:
            columns, values = _gathered(group, n - 1)
            s = group.column("shard")[0].as_py()
            hashes = chained(columns)
            order_ = np.argsort(hashes)
            save(f"{folder}/{n}c-{s}.value.npy", np.stack(values)[:, order_].astype(np.int64))
            save(f"{folder}/{n}c-{s}.key.npy", hashes[order_])
            return pa.Table.from_batches([table([(SUMS, s, len(hashes), None)], BLOBS)])

        return run

    rows = texts.mapInArrow(count_ngrams, BLOBS)
    for n in range(order, 0, -1):
        done = cut(rows.groupBy("shard").applyInArrow(save_ngrams(n), MADE))
        sums = done.filter(F.col("kind") == SUMS).select("shard", "n", "total", "n1", "n2", "n3", "n4", "more").collect()
        size = {r["shard"]: r["n"] for r in sums}
        model.sizes[n] = [size.get(s, 0) for s in range(shards)]
        model.discounts[n] = discounts([sum(r[f"n{k}"] for r in sums) for k in (1, 2, 3, 4)])
        model.totals[n] = [sum(r[c] for r in sums) for c in ("total", "n1", "n2", "more")]
        if n > 1:
            there = {r["shard"] for r in done.filter(F.col("kind") == CONTEXTS).select("shard", "n", "data").withColumn("kind", F.lit(CONTEXTS)).groupBy("shard").applyInArrow(save_contexts(n), BLOBS).select("shard").collect()}
            for s in set(range(shards)) - there:
                save(f"{folder}/{n}c-{s}.key.npy", np.full(1, UNKNOWN, dtype=U))
                save(f"{folder}/{n}c-{s}.value.npy", np.zeros((4, 1), np.int64))
            rows = done.filter(F.col("kind") == NGRAMS).select("kind", "shard", "n", "data")
    return model


def _and_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _hashes(b: pa.RecordBatch | None) -> Iterator[np.ndarray]:
    if b is not None:
        for _, _, data, offsets in pieces(b.column("text"), PIECE):
            yield words(data, offsets, SPACED).hashes()


def _sequences(b: pa.RecordBatch | None, arrays: Mapped, order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    if b is not None:
        for _, _, data, offsets in pieces(b.column("text"), PIECE):
            w = words(data, offsets, SPACED)
            _, place = arrays.counts(0, w.hashes())
            seq, first = sequence(place.astype(U) + U(WORDS), w.count, order)
            yield seq, first, w.count


def _predicted(p: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Which places hold a token and no start mark."""
    text = np.searchsorted(first, p, side="right") - 1
    return (text >= 0) & (p <= first[text] + count[text])


def _gathered(group: pa.Table, n: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The merged rows of a shard: n columns of ids, and values."""
    parts = [unpacked(d, m) for d, m in zip(group.column("data").to_pylist(), group.column("n").to_pylist())]
    columns = [np.concatenate(x) for x in zip(*parts)]
    ids, values = merged(columns[:n], [c.astype(np.int64) for c in columns[n:]])
    return ids, values


def discounts(of: list[int]) -> list[float]:
    """What counts of 0, 1, 2 and more lose, from the numbers of n-grams counted 1 to 4 times."""
    n1, n2, n3, n4 = of
    if n1 and n2 and n3:
        y = n1 / (n1 + 2 * n2)
        d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
        if all(0 < x < k for k, x in enumerate(d, 1)):
            return [0.0, *d]
    return [0.0, 0.5, 1.0, 1.5]


def logs(arrays: Mapped, seq: np.ndarray, p: np.ndarray) -> np.ndarray:
    """log10 of the probability of the tokens at places p of a sequence of ids."""
    model = arrays.model
    out = np.full(len(p), 1 / (model.distinct + 1))
    for n in range(1, model.order + 1):
        columns = [seq[p - k] for k in range(n - 1, -1, -1)]
        count, _ = arrays.counts(n, chained(columns))
        total = [np.full(len(p), x) for x in model.totals[1]] if n == 1 else arrays.contexts(n, chained(columns[:-1]))
        d = np.array(model.discounts[n])
        seen = np.maximum(total[0], 1)
        spared = (d[1] * total[1] + d[2] * total[2] + d[3] * total[3]) / seen
        out = np.where(total[0] > 0, np.maximum(count - d[np.minimum(count, 3)], 0) / seen + spared * out, out)
    return np.log10(out)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` and ``perplexity`` of each row of ``docs``.

    ``base_score`` is the log10 probability by words alone, one added to each count.
    """
    names = ["n_tokens", "n_known", "base_score", "score"]
    base = model.tokens + model.distinct + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = mapped(model)
        for b in batches:
            n, known = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            plain, full = np.zeros(b.num_rows), np.zeros(b.num_rows)
            for at, to, data, offsets in pieces(b.column(b.num_columns - 1), PIECE):
                w = words(data, offsets, SPACED)
                c, place = arrays.counts(0, w.hashes())
                row = np.repeat(np.arange(at, to), w.count)
                n[at:to] = w.count + 1
                known[at:to] = np.bincount(row[c > 0] - at, minlength=to - at) + (model.ends > 0)
                plain[at:to] = np.bincount(row - at, np.log10((c + 1) / base), minlength=to - at) + np.log10((model.ends + 1) / base)
                seq, first = sequence(np.where(place < 0, U(UNKNOWN), place.astype(U) + U(WORDS)), w.count, model.order)
                for low in range(0, len(seq), SLICE):
                    p = np.arange(max(low, model.order - 1), min(low + SLICE, len(seq)))
                    p = p[_predicted(p, first, w.count)]
                    full[at:to] += np.bincount(np.searchsorted(first, p, side="right") - 1, logs(arrays, seq, p), minlength=to - at)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(x) for x in (n, known, plain, full))], [*b.schema.names[:-1], *names])

    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]), "n_tokens long, n_known long, base_score double, score double"])
    out = rows.mapInArrow(run, schema)
    return out.select(*keep, "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
