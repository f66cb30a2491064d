"""Ranked lexical search: exact top-k by dual-sorted wavelet trees, one for each shard of documents.

A shard holds some documents in the order of their ids, numbered from 0. Its postings stand term
after term, each term's by falling impact; the sequence of their document numbers is kept as a
wavelet tree, so every node of it is a range of numbers, and within a node each term's postings
are still one run by falling impact. So the first of each run tells the most that a term can give
to any document of the node, and the sum over the query's terms bounds the node's scores.

A search goes best first: it takes the nodes of the highest bounds, splits each term's run in two
by rank on the node's bits, and drops children that hold no posting or whose bound can't beat the
k-th best document so far (nor tie with it at a smaller id). At a leaf the bound is the score, so the result is exact. Nodes
are taken in bites of a growing number, so that the work is array operations.

A shard is made by one task from consecutive rows, until ``tokens`` terms are in; its size is bounded by that or by one
document. The index is a table of one row a shard, so building and searching shuffle nothing but
results: at most k rows for each item and task. Items go to all tasks in blocks of about ``block`` terms,
one block after another; a block's terms are what the driver holds.

Impacts need the mean length of all documents, so lengths are summed first, by the JVM.

Defined cases: null and empty texts hold no term, so such documents aren't found and such items
find nothing; a null document id counts as the largest long; rows that repeat a document id are
found each; items that repeat an id are one, of the smallest text; null item ids are one item;
texts are taken whole, however long; extra columns are ignored, whatever their names; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .tokens import LETTERED, U, pieces, words

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SHARD = "ids binary, terms binary, starts binary, impacts binary, bits binary"
LAST = (1 << 63) - 1
#: A bite holds nodes whose bounds come to this share of the highest one.
NEAR = 0.7


class Tree(NamedTuple):
    """A shard. ``terms``: sorted hashes, whose postings are ``starts[i]`` to ``starts[i + 1]``.

    ``zeros[l, i]``: how many of the first i postings of level l go left. ``impacts[l]``: of the
    postings as level l has them; ``left[l]``: how many go left in all.
    """

    ids: np.ndarray
    terms: np.ndarray
    starts: np.ndarray
    impacts: np.ndarray
    zeros: np.ndarray
    left: np.ndarray

    @property
    def depth(self) -> int:
        return len(self.zeros)


def stats(docs: DataFrame) -> tuple[int, int]:
    """How many documents hold a term, and all their terms."""
    n = F.coalesce(F.regexp_count("text", F.lit(TERM)), F.lit(0)).cast("long")
    r = docs.agg(F.count(F.when(n > 0, 1)), F.coalesce(F.sum(n), F.lit(0))).first()
    return r[0], r[1]


def shard(ids: np.ndarray, count: np.ndarray, hashes: np.ndarray, n_docs: int, n_terms: int) -> list[bytes]:
    """The row of a shard: its documents' ids, number of terms each, and the terms' hashes one document after another."""
    order = np.argsort(ids, kind="stable")
    number = np.empty_like(order)
    number[order] = np.arange(len(order))
    terms, term = np.unique(hashes, return_inverse=True)
    place, tf = np.unique(term.astype(np.int64) * len(ids) + np.repeat(number, count), return_counts=True)
    term, doc = np.divmod(place, max(1, len(ids)))
    m = 25 + (75 * count[order].astype(np.int64) * n_docs) // n_terms
    impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
    falling = np.argsort((term << 21) - impact, kind="stable")
    current, rows = doc[falling], []
    depth = max(1, int(len(ids) - 1).bit_length())
    for level in range(depth):
        right = (current >> (depth - 1 - level) & 1).astype(bool)
        rows.append(np.packbits(right))
        current = np.concatenate([current[~right], current[right]])
    starts = np.searchsorted(term, np.arange(len(terms) + 1))
    return [x.tobytes() for x in (ids[order].astype(np.int64), terms, starts.astype(np.int32), impact[falling].astype(np.int32), np.concatenate(rows))]


def opened(row: dict) -> Tree:
    ids, terms = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["terms"], U)
    starts, impact = np.frombuffer(row["starts"], np.int32), np.frombuffer(row["impacts"], np.int32)
    n, depth = len(impact), max(1, int(len(ids) - 1).bit_length())
    bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8).reshape(depth, -1), axis=1, count=n).astype(bool)
    zeros, impacts = np.zeros((depth, n + 1), np.int32), np.empty((depth + 1, n), np.int32)
    impacts[0] = impact
    for level in range(depth):
        np.cumsum(~bits[level], out=zeros[level, 1:])
        impacts[level + 1] = np.concatenate([impacts[level][~bits[level]], impacts[level][bits[level]]])
    return Tree(ids, terms, starts, impacts, zeros, zeros[:, -1].astype(np.int64))


def index(docs: DataFrame, n_docs: int, n_terms: int, tokens: int = 2_000_000) -> DataFrame:
    """One row a shard of documents (``doc_id``, ``text``)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def row() -> pa.RecordBatch:
            made = shard(*(np.concatenate(x) for x in zip(*held)), n_docs, n_terms)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in made], [c.split()[0] for c in SHARD.split(", ")])

        for b in batches:
            ids = b.column(0).fill_null(LAST).to_numpy()
            for at, to, data, offsets in pieces(b.column(1)):
                w = words(data, offsets, LETTERED)
                some = w.count > 0
                if some.any():
                    held.append((ids[at:to][some], w.count[some], w.hashes()))
                    size += len(w.starts)
                if size >= tokens:
                    yield row()
                    size = 0
        if held:
            yield row()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(build, SHARD)


def trees(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield {c: b.column(c)[i].as_py() for c in names}


class Best:
    """The k best (score, id) so far."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((i, -s))[: self.k]
        self.scores, self.ids = s[order], i[order]

    def may_hold(self, bounds: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Whether documents of at most these scores, from these ids on, can be among the best."""
        if len(self.scores) < self.k:
            return bounds > 0
        return (bounds > self.scores[-1]) | ((bounds == self.scores[-1]) & (first < self.ids[-1]))


def search(tree: Tree, weights: np.ndarray, low: np.ndarray, high: np.ndarray, best: Best) -> int:
    """Adds the shard's best documents for terms of such weights and runs of postings; gives the number of nodes taken."""
    if not len(weights):
        return 0
    # The frontier: nodes, and for each its rows, one for each term that it holds.
    bound, level, prefix = np.array([int((weights * tree.impacts[0, low]).sum())]), np.zeros(1, np.int64), np.zeros(1, np.int64)
    count, w, sp, ep = np.array([len(weights)]), weights, low.astype(np.int64), high.astype(np.int64)
    taken, bite = 0, 4
    fine = best.may_hold(bound, tree.ids[:1])
    while True:
        if not fine.all():
            rows = np.repeat(fine, count)
            bound, level, prefix, count = bound[fine], level[fine], prefix[fine], count[fine]
            w, sp, ep = w[rows], sp[rows], ep[rows]
        if not len(bound):
            return taken
        chosen = bound >= bound.max() * NEAR
        if chosen.sum() > bite:
            chosen[:] = False
            chosen[np.argpartition(-bound, bite)[:bite]] = True
        taken += int(chosen.sum())
        bite = min(2 * bite, 2048)
        rows = np.repeat(chosen, count)
        tw, ts, te = w[rows], sp[rows], ep[rows]
        many, lv, pre = count[chosen], level[chosen], prefix[chosen]
        row_level = np.repeat(lv, many)
        begins = np.cumsum(many) - many
        a, z = tree.zeros[row_level, ts].astype(np.int64), tree.zeros[row_level, te].astype(np.int64)
        right = tree.left[row_level] - a + ts
        sides = []
        for side, (s, e) in enumerate(((a, z), (right, right + (te - ts) - (z - a)))):
            holds = e > s
            most = np.where(holds, tw * tree.impacts[row_level + 1, np.where(holds, s, 0)], 0)
            b = np.add.reduceat(most, begins)
            child, deep = 2 * pre + side, lv + 1
            keep = b > 0
            keep[keep] = best.may_hold(b[keep], tree.ids[child[keep] << (tree.depth - deep[keep])])
            leaf = keep & (deep == tree.depth)
            if leaf.any():
                best.add(b[leaf], tree.ids[child[leaf]])
            inner = keep & ~leaf
            some = np.repeat(inner, many) & holds
            sides.append((b[inner], deep[inner], child[inner], np.add.reduceat(holds.astype(np.int64), begins)[inner], tw[some], s[some], e[some]))
        stay, rest = ~chosen, ~rows
        sides.append((bound[stay], level[stay], prefix[stay], count[stay], w[rest], sp[rest], ep[rest]))
        bound, level, prefix, count, w, sp, ep = (np.concatenate(x) for x in zip(*sides))
        fine = best.may_hold(bound, tree.ids[prefix << (tree.depth - level)])


def item_terms(items: DataFrame) -> DataFrame:
    """(``item_id``, ``terms``: the hashes of its terms, repeats included) of each item with terms."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, to, data, offsets in pieces(b.column(1)):
                w = words(data, offsets, LETTERED)
                h, ends = w.hashes(), np.cumsum(w.count)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, to - at), pa.array([h[e - n : e].tobytes() for n, e in zip(w.count, ends)], pa.binary())], ["item_id", "terms"])

    one = items.groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.min(F.col("text").cast("string")).alias("text"))
    return one.mapInArrow(hashed, "item_id long, terms binary").filter(F.length("terms") > 0)


def _block(shards: DataFrame, asked: list[tuple[int | None, bytes]], n_docs: int, k: int) -> DataFrame:
    """The k best of all shards for each item of a block."""
    names = [np.unique(np.frombuffer(t, U), return_counts=True) for _, t in asked]
    every = np.unique(np.concatenate([x for x, _ in names]))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(every), np.int64)
        for t in trees(batches, ["terms", "starts"]):
            terms, starts = np.frombuffer(t["terms"], U), np.frombuffer(t["starts"], np.int32)
            at = np.minimum(np.searchsorted(terms, every), len(terms) - 1)
            df += np.where(terms[at] == every, starts[at + 1] - starts[at], 0)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(df)), pa.array(df[df > 0])], ["term", "df"])

    df = np.zeros(len(every), np.int64)
    for r in shards.select("terms", "starts").mapInArrow(held, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r["term"]] = r["df"]
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], dtype=np.int64)
    wanted = [(np.searchsorted(every, x), n) for x, n in names]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in asked]
        for row in trees(batches, [c.split()[0] for c in SHARD.split(", ")]):
            tree = opened(row)
            at = np.minimum(np.searchsorted(tree.terms, every), len(tree.terms) - 1)
            here = (tree.terms[at] == every) & (weight > 0)
            for found, (terms, n) in zip(best, wanted):
                some = here[terms]
                t = terms[some]
                search(tree, weight[t] * n[some], tree.starts[at[t]], tree.starts[at[t] + 1], found)
        for (item, _), found in zip(asked, best):
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(found.ids), pa.int64()), pa.array(found.ids), pa.array(found.scores)], ["item_id", "doc_id", "score"])

    hits = shards.mapInArrow(find, "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_documents(docs: DataFrame, items: DataFrame, k: int = 10, tokens: int = 2_000_000, block: int = 500_000) -> DataFrame:
    """(``item_id``, ``rank``, ``doc_id``, ``score``): each item's k best documents of score above 0."""
    spark = docs.sparkSession
    n_docs, n_terms = stats(docs)
    asking = cut(item_terms(items))
    size = asking.agg(F.sum(F.length("terms"))).first()[0] or 0
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    if not (n_docs and size and k):
        return out
    shards = cut(index(docs, n_docs, n_terms, tokens))
    blocks = -(-size // (8 * block))
    for b in range(blocks):
        asked = asking.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        if asked:
            best = _block(shards, [(r["item_id"], bytes(r["terms"])) for r in asked], n_docs, k)
            out = out.unionByName(cut(best.select("item_id", "rank", F.when(F.col("doc_id") < LAST, F.col("doc_id")).alias("doc_id"), "score")))
    return out
