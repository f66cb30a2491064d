"""SimHash near-duplicates: BK-trees over shards of the fingerprints.

A fingerprint has 64 bits: a bit is set if it is set in over half of the XXH64 hashes
of the text's shingles. Two fingerprints link if at most ``radius`` bits differ.

Search: fingerprints are keyed so that linked ones share a shard, and each shard is
searched with a BK-tree, whose children are keyed by the Hamming distance to the parent:
a query follows only edges within the radius of its own distance. Trees reach their
queries through the shuffle by shard, not by a broadcast: they grow with the data. A task
returns a spanning forest of the links it found, not all pairs; classes come from stars
over those forests. Equal fingerprints are one node, so exact copies cost nothing here.

Keys of 64-bit fingerprints (``near_duplicates``): the bits are cut into blocks. Two linked
fingerprints agree on at least blocks - radius blocks, so for every choice of that many
blocks those that agree on them form a shard, and no link is missed. There are more blocks
where there are more fingerprints, so that shards don't grow with the input.

Keys by similarity (``similar_classes``): at a similarity of 0.8 some ten of 64 bits differ,
at which a BK-tree prunes nothing and blocks are of no use. Shards are bands of minima of
permuted shingle hashes instead, wider and more of them as the input grows; the trees hold
fingerprints of 256 bits, and what they find is verified by the exact similarity of
the shingle sets.

Hot shards, of over ``tile`` fingerprints, are not searched pair by pair. Their members are
first linked to ``PIVOTS`` of them, in tiles. Most of a large group of near copies is then
one class, and only members outside a shard's largest class are searched against all of it,
again in tiles, so no task holds a whole hot shard and the work isn't the square of it.

Defined cases: null and wordless texts have the fingerprint 0 and link like any
other; rows of null id get their class's smallest id (null if it has none); repeated
rows share a class; an empty table gives an empty one; more input columns are ignored,
whatever their names (``one_of_each`` keeps them; names that start with ``_nd_`` are
reserved).
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import accumulate, combinations, groupby, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, forget, swept

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
CHUNK = 1 << 15


def hashes_of(text: str | None, words: int, seed: int = 42) -> Iterator[np.ndarray]:
    """The XXH64 hashes of a text's shingles, ``CHUNK`` at a time; none without words."""
    from xxhash import xxh64_digest

    parts = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not parts:
        return
    whole = b" ".join(parts)
    ends = [e - 1 for e in accumulate(map(len, parts), lambda a, n: a + n + 1, initial=0)][1:]
    starts = [0, *(e + 1 for e in ends[:-1])]
    last = ends[words - 1 :] or [len(whole)]
    for i in range(0, len(last), CHUNK):
        to = last[i : i + CHUNK]
        digests = b"".join(map(xxh64_digest, [whole[a:b] for a, b in zip(starts[i : i + CHUNK], to)], repeat(seed)))
        yield np.frombuffer(digests, ">u8").astype(np.uint64)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Distinct 64-bit hashes of a text's shingles, sorted; each is mixed from the hashes of its words."""
    from xxhash import xxh64_intdigest

    parts = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not parts:
        return np.zeros(0, np.uint64)
    known = {w: xxh64_intdigest(w) for w in set(parts)}
    each = np.fromiter(map(known.__getitem__, parts), np.uint64, len(parts))
    words = min(words, len(parts))
    out = np.full(len(parts) - words + 1, words, np.uint64)
    for i in range(words):
        out = (out ^ each[i : len(parts) - words + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out * np.uint64(0xBF58476D1CE4E5B9))


def bits_of(hashes: Iterable[np.ndarray], lanes: int = 1) -> bytes:
    """The fingerprint of chunks of hashes, 8 bytes a lane; lanes after the first count the bits of remixed hashes."""
    ones, n = np.zeros(64 * lanes, dtype=np.int64), 0
    for part in hashes:
        n += len(part)
        for lane in range(lanes):
            if lane:
                part = part * np.uint64(0xD1342543DE82EF95) + np.uint64(0x9E3779B97F4A7C15)
            mixed = part if not lane else (part ^ (part >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
            bits = np.unpackbits(mixed.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            ones[64 * lane : 64 * lane + 64] += bits.sum(axis=0, dtype=np.int32)
    return np.packbits(2 * ones > n).tobytes()


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """The unsigned 64-bit fingerprint of a whole text."""
    return int.from_bytes(bits_of(hashes_of(text, words, seed)), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(``doc_id``, ``fp``) of every row; the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = b"".join(bits_of(hashes_of(t.as_py(), words)) for t in b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.frombuffer(bits, ">i8").astype(np.int64))], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def hamming(values: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Distances of rows of lanes from one row."""
    return np.bitwise_count(values ^ one).sum(axis=1, dtype=np.int16)


class BKTree:
    """A BK-tree over rows of 64-bit lanes: children keyed by the distance to the parent."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.children: list[list[tuple[int, int]]] = [[] for _ in values]
        todo = [(0, np.arange(1, len(values)))] if len(values) > 1 else []
        while todo:
            node, below = todo.pop()
            distance = hamming(values[below], values[node])
            order = np.argsort(distance, kind="stable")
            below, distance = below[order], distance[order]
            new = np.flatnonzero(np.diff(distance)) + 1
            for group, d in zip(np.split(below, new), distance[np.append(0, new)].tolist()):
                self.children[node].append((d, int(group[0])))
                if len(group) > 1:
                    todo.append((int(group[0]), group[1:]))

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Yields (node, positions of the queries within the radius of it, their distances); all queries descend together."""
        todo = [(0, np.arange(len(queries)))] if len(self.values) else []
        while todo:
            node, active = todo.pop()
            distance = hamming(queries[active], self.values[node])
            near = np.flatnonzero(distance <= radius)
            if len(near):
                yield node, active[near], distance[near]
            for d, child in self.children[node]:
                follow = active[np.abs(distance - d) <= radius]
                if len(follow):
                    todo.append((child, follow))


Pairs = list[tuple[int, int]]


def near_pairs(values: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(node, others, distances) by place: those of ``right`` within the radius of each of ``left``, from a BK-tree of ``left``."""
    for node, near, distance in BKTree(values[left]).search(values[right], radius):
        yield int(left[node]), right[near], distance


def forest(ids: np.ndarray, values: np.ndarray, label: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int) -> Pairs:
    """A spanning forest, as (id, smallest id of its part), of the links between ``left`` and ``right``; rows of one label are one already."""
    label = np.unique(label, return_inverse=True)[1]
    first = label.copy()
    for node, near, _ in near_pairs(values, left, right, radius):
        found = label[near]
        if (found != label[node]).any():
            parts = np.unique(np.append(found, label[node]))
            label[np.isin(label, parts)] = parts[0]
    out: Pairs = []
    for part in np.flatnonzero(np.bincount(label) > 1):
        members = np.flatnonzero(label == part)
        if len(np.unique(first[members])) > 1:
            # One row of each label of before stands for the others of it.
            chosen = ids[members[np.unique(first[members], return_index=True)[1]]]
            root = int(chosen.min())
            out += [(int(m), root) for m in np.unique(chosen) if m != root]
    return out


def nearest_first(ids: np.ndarray, values: np.ndarray, radius: int) -> Pairs:
    """Pairs to verify: a spanning forest of the pairs within the radius, of the least distances in all (Prim)."""
    n, far = len(ids), radius + 1
    every = np.arange(n)
    distance = np.full((n, n), far, np.int16)
    for node, near, d in near_pairs(values, every, every, radius):
        distance[node, near] = d
    np.fill_diagonal(distance, far)
    out: Pairs = []
    left, best, to = np.ones(n, bool), np.full(n, far, np.int16), np.zeros(n, np.int64)
    for _ in range(n):
        at = int(np.where(left, best, far + 1).argmin())
        if best[at] < far:
            out.append((int(ids[at]), int(ids[to[at]])))
        left[at] = False
        nearer = distance[at] < best
        best[nearer], to[nearer] = distance[at][nearer], at
    return out


def alike(mine: np.ndarray, others: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which of the sets ``others`` have a Jaccard similarity of ``similarity`` or more to the sorted set ``mine``; none is empty."""
    sizes = np.array([len(x) for x in others])
    joined = np.concatenate(others)
    at = np.minimum(np.searchsorted(mine, joined), len(mine) - 1)
    both = np.add.reduceat((mine[at] == joined).astype(np.int64), np.append(0, np.cumsum(sizes)[:-1]))
    return both >= similarity * (len(mine) + sizes - both)


def exact_links(mask: int, ids: np.ndarray, values: np.ndarray, label: np.ndarray, keys: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, radius: int, similarity: float) -> Pairs:
    """A spanning forest of the exact links between ``left`` and ``right``; rows of one label are one already. A pair of several bands is tested in the first of them."""
    part, out = np.unique(label, return_inverse=True)[1], []
    sizes = np.array([len(x) for x in sets])
    for node, near, distance in near_pairs(values, left, right, radius):
        low, high = np.minimum(sizes[near], sizes[node]), np.maximum(sizes[near], sizes[node])
        todo = near[np.argsort(distance, kind="stable")]
        fits = (low > 0) & (low >= similarity * high) & ((keys[near] == keys[node]).argmax(axis=1) == mask)
        todo = todo[fits[np.argsort(distance, kind="stable")]]
        while len(todo := todo[part[todo] != part[node]]):
            now, todo = todo[:64], todo[64:]
            for x in now[alike(sets[node], [sets[x] for x in now], similarity)]:
                if part[x] != part[node]:
                    out.append((int(ids[node]), int(ids[x])))
                    part[part == part[x]] = part[node]
    return out


def nearest_pivots(ids: np.ndarray, values: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int, most: int = 3) -> Pairs:
    """Pairs to verify: each of ``right`` with the nearest few of the pivots ``left``."""
    distance = np.stack([hamming(values[right], values[p]) for p in left])
    distance[ids[left][:, None] == ids[right][None]] = radius + 1
    out: Pairs = []
    for at in np.argsort(distance, axis=0, kind="stable")[:most]:
        good = np.flatnonzero(distance[at, np.arange(len(right))] <= radius)
        out += zip(ids[right[good]].tolist(), ids[left[at[good]]].tolist())
    return out


def masks(blocks: int, radius: int) -> list[int]:
    """For each choice of ``blocks - radius`` blocks, the mask of their bits, as a signed long."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    out = [sum(c) for c in combinations(block, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def blocks_for(rows: int, radius: int = 4, room: int = 64) -> int:
    """The fewest blocks with which ``rows`` random fingerprints make shards of ``room`` at most: 6 to 2**27 of them, 7 to 2**33."""
    return next(b for b in range(radius + 2, 33) if b == 32 or rows <= room << (64 * (b - radius) // b))


def keyed_by_blocks(distinct: DataFrame, radius: int, blocks: int) -> DataFrame:
    """(``fp``, ``bits``, ``mask``, ``key``) of rows with ``fp``: every choice of blocks of a 64-bit fingerprint; no link is missed."""
    keys = F.array(*[F.struct(F.lit(i).cast("int").alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks(blocks, radius))])
    bits = F.unhex(F.lpad(F.hex("fp"), 16, "0"))
    return distinct.select("fp", bits.alias("bits"), F.explode(keys).alias("_k")).select("fp", "bits", "_k.*")


def bands_for(rows: int, similarity: float, miss: float = 1e-4) -> tuple[int, int]:
    """(bands, minima in each): a pair at ``similarity`` shares no band with a probability of ``miss`` at most, and a band is wider the more rows there are."""
    wide = max(5, math.ceil(math.log10(max(1, rows))) - 1)
    return math.ceil(math.log(miss) / math.log(1 - similarity**wide)), wide


def band_keys(hashes: np.ndarray, bands: int, wide: int) -> np.ndarray:
    """A key for each band: the hash of ``wide`` minima of permuted shingle hashes. No shingles: all alike."""
    draw = np.random.default_rng(11).integers(1, 1 << 63, size=(2, bands * wide, 1), dtype=np.uint64)
    low = np.full(bands * wide, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 1024):
        low = np.minimum(low, (hashes[None, i : i + 1024] * (draw[0] | np.uint64(1)) + draw[1]).min(axis=1))
    low = (low ^ (low >> np.uint64(31))).reshape(bands, wide)
    key = np.zeros(bands, np.uint64)
    for j in range(wide):
        key = (key ^ low[:, j]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


DEALT = ("mask", "key", "i", "j", "left", "right", "fp", "label", "bits")
GROUP = DEALT[:4]
PIVOTS = 16


def _tiles(rows: Column) -> Column:
    return F.ceil(rows).cast("int")


def _own(tiles: str) -> Column:
    """Which of the tiles of its shard a fingerprint is in."""
    return F.pmod(F.xxhash64("fp", F.lit(3)), F.col(tiles)).cast("int")


def _each(n: Column) -> Column:
    """A row for each tile."""
    return F.explode(F.sequence(F.lit(0), n - 1))


def hot_shards(keyed: DataFrame, tile: int) -> tuple[DataFrame, int]:
    """(``mask``, ``key``, ``tiles``) of the shards of over a tile, and how many they are."""
    hot = cut(keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).filter(F.col("n") > tile).select("mask", "key", _tiles(F.col("n") / tile).alias("tiles")))
    return hot, hot.count()


def _of_shards(keyed: DataFrame, shards: DataFrame, n: int, how: str = "inner") -> DataFrame:
    """``keyed`` joined with a table of shards; one of up to 200,000 shards is some MB and is broadcast."""
    return keyed.join(F.broadcast(shards) if n <= 200_000 else shards, ["mask", "key"], how)


def first_round(keyed: DataFrame, hot: DataFrame, n_hot: int) -> DataFrame:
    """``DEALT``: each small shard by itself, each tile of a hot one with the shard's pivots."""
    here = F.lit(True)
    none = F.lit(0)
    plain = lambda df: df.select("mask", "key", none.alias("i"), none.alias("j"), here.alias("left"), here.alias("right"), "fp", F.col("fp").alias("label"), "bits")
    if not n_hot:
        return plain(keyed)
    marked = _of_shards(keyed, hot, n_hot, "left")
    inside = marked.filter("tiles is not null").withColumn("own", _own("tiles"))
    tiled = lambda df, left: df.select("mask", "key", "own", F.lit(1).alias("j"), F.lit(left).alias("left"), F.lit(not left).alias("right"), "fp", F.col("fp").alias("label"), "bits").withColumnRenamed("own", "i")
    few = inside.groupBy("mask", "key", F.pmod(F.xxhash64("fp", F.lit(5)), F.lit(PIVOTS)).alias("_n")).agg(F.min(F.struct(F.xxhash64("fp", F.lit(7)).alias("h"), "fp", "bits", "tiles")).alias("p"))
    pivots = few.select("mask", "key", "p.fp", "p.bits", _each(F.col("p.tiles")).alias("own"))
    return plain(marked.filter("tiles is null").select("mask", "key", "fp", "bits")).unionByName(tiled(inside, False)).unionByName(tiled(pivots, True))


def second_round(keyed: DataFrame, shards: DataFrame, n_shards: int, classes: DataFrame, tile: int) -> DataFrame:
    """``DEALT``: of ``shards`` (``mask``, ``key``), the members outside the largest class of ``classes`` (``node``, ``root``) with all members, in tiles."""
    rows = _of_shards(keyed, shards.select("mask", "key"), n_shards)
    rows = cut(rows.join(classes, F.col("fp") == F.col("node"), "left").select("mask", "key", "fp", "bits", F.coalesce("root", "fp").alias("label")))
    counted = rows.groupBy("mask", "key", "label").agg(F.count("*").alias("n"))
    split = counted.groupBy("mask", "key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("all"), (F.sum("n") - F.max("n")).alias("rest"))
    split = cut(split.filter("rest > 0").select("mask", "key", "main", _tiles(F.col("all") / tile).alias("tiles"), _tiles(F.col("rest") / tile).alias("parts")))
    mixed = _of_shards(rows, split, n_shards)
    shape = lambda df, left: df.select("mask", "key", "i", "j", F.lit(left).alias("left"), F.lit(not left).alias("right"), "fp", "label", "bits")
    others = mixed.filter("label != main").withColumn("i", _own("parts")).withColumn("j", _each(F.col("tiles")))
    every = mixed.withColumn("j", _own("tiles")).withColumn("i", _each(F.col("parts")))
    return shape(others, True).unionByName(shape(every, False))


def searched(dealt: DataFrame, radius: int, exact: bool) -> DataFrame:
    """(``mask``, ``key``, ``a``, ``b``), a > b: a forest of the links in each group of ``dealt``, or, if a link is only ``exact`` once verified, the nearest pairs to verify."""
    dealt = dealt.select(*DEALT).repartition(*GROUP).sortWithinPartitions(*GROUP)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, values = None, None
        for b in batches:
            if not b.num_rows:
                continue
            now = np.stack([b.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in DEALT[:-1]])
            bits = np.frombuffer(b"".join(b.column("bits").to_pylist()), np.uint64).reshape(b.num_rows, -1)
            rest, values = (now, bits) if rest is None else (np.concatenate([rest, now], axis=1), np.concatenate([values, bits]))
            new = np.flatnonzero((rest[:4, 1:] != rest[:4, :-1]).any(axis=0)) + 1
            if len(new):
                yield batch(rest[:, : new[-1]], values[: new[-1]], new[:-1])
                rest, values = rest[:, new[-1] :], values[new[-1] :]
        if rest is not None:
            yield batch(rest, values, np.array([], dtype=int))

    def batch(rows: np.ndarray, values: np.ndarray, new: np.ndarray) -> pa.RecordBatch:
        bounds = np.concatenate([[0], new, [rows.shape[1]]])
        out: list[np.ndarray] = []
        for at in np.flatnonzero(np.diff(bounds) > 1):
            part = slice(bounds[at], bounds[at + 1])
            ids, own = rows[6, part], values[part]
            left, right = np.flatnonzero(rows[4, part]), np.flatnonzero(rows[5, part])
            if not exact:
                found = forest(ids, own, rows[7, part], left, right, radius)
            elif rows[3, bounds[at]]:
                found = nearest_pivots(ids, own, left, right, radius) if len(left) else []
            else:
                found = nearest_first(ids, own, radius)
            found = list({(max(p), min(p)) for p in found if p[0] != p[1]})
            if found:
                pairs = np.array(found, dtype=np.int64)
                out.append(np.column_stack([np.broadcast_to(rows[:2, bounds[at]], (len(pairs), 2)), pairs]))
        every = np.concatenate(out) if out else np.zeros((0, 4), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(every[:, 0].astype(np.int32)), *(pa.array(every[:, i]) for i in (1, 2, 3))], ["mask", "key", "a", "b"])

    return dealt.mapInArrow(run, "mask int, key long, a long, b long")


def searched_exactly(dealt: DataFrame, radius: int, similarity: float) -> DataFrame:
    """(``a``, ``b``), a > b: forests of the exact links in each group of ``dealt``, which has ``keys`` and ``hashes``, the sets, too."""
    dealt = dealt.select(*DEALT, "keys", "hashes").repartition(*GROUP).sortWithinPartitions(*GROUP)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, rows in groupby((r for b in batches for r in zip(*(c.to_pylist() if i < 10 else map(_longs, c) for i, c in enumerate(b.columns)))), key=lambda r: r[:4]):
            left, right, ids, label, bits, keys, sets = zip(*(r[4:] for r in rows))
            values = np.frombuffer(b"".join(bits), np.uint64).reshape(len(bits), -1)
            found = exact_links(group[0], np.array(ids), values, np.array(label), np.array(keys), list(sets), np.flatnonzero(left), np.flatnonzero(right), radius, similarity)
            a, b = zip(*((max(p), min(p)) for p in found)) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _longs(one: pa.ListScalar) -> np.ndarray:
    return one.values.to_numpy()


def links(keyed: DataFrame, radius: int, tile: int = 1024) -> DataFrame:
    """(``a``, ``b``), a > b: forests over all links of fingerprints that share a shard."""
    hot, n_hot = hot_shards(keyed, tile)
    found = searched(first_round(keyed, hot, n_hot), radius, False).select("a", "b").distinct()
    if not n_hot:
        return found
    found = cut(found)
    return found.unionByName(searched(second_round(keyed, hot, n_hot, stars(found), tile), radius, False).select("a", "b").distinct())


def stars(edges: DataFrame) -> DataFrame:
    """(``node``, ``root``) for every node but the roots of the (``a``, ``b``), a > b, edges: alternating large and small stars.

    Each round points larger neighbours to a node's smallest one, then a node and its
    smaller neighbours to the smallest; it ends when the edges are stars and stay so, told
    by two 64-bit sums of hashes. Written minima make both sides of each join shuffle, so
    that skewed hubs are split.
    """
    edges = cut(edges)
    seen = None
    while True:
        sums = (F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("b", "a")))
        now = tuple(edges.agg(F.count("*"), *sums).first())
        if now == seen or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).union(edges.select(F.col("b"), F.col("a")))
        least = cut(both.groupBy("node").agg(F.min("near").alias("low")).select("node", F.least("node", "low").alias("low")))
        large = edges.join(least, edges.b == least.node).select("a", F.col("low").alias("b"))
        large = cut(large.filter("a > b").distinct())
        forget(edges, least)
        low = cut(large.groupBy("a").agg(F.min("b").alias("low")))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")).select("e.*")
        edges = cut(small.filter("a > b").distinct())
        forget(large, low)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4, blocks: int | None = None, tile: int = 1024) -> DataFrame:
    """(``doc_id``, ``fingerprint``, ``component_id``) of every row, by 64-bit fingerprints; every link counts.

    ``blocks``: more of them make smaller shards and more copies of each fingerprint (15 at
    6, 35 at 7, 70 at 8); by default as many as the distinct fingerprints need.
    """
    marked = cut(fingerprints(docs, id_col, text_col, words))
    with swept(docs.sparkSession) as keep:
        distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
        keyed = keyed_by_blocks(distinct, radius, blocks or blocks_for(distinct.count(), radius))
        rooted = cut(stars(links(keyed, radius, tile)))
        members = rooted.union(rooted.select("root", "root").distinct()).join(distinct, F.col("node") == F.col("fp")).select("node", "root", "least")
        least = cut(members.groupBy("root").agg(F.min("least").alias("component_id")))
        found = cut(members.join(least, "root").select(F.col("node").alias("fp"), "component_id"))
        known = cut(distinct.join(found, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")))
        keep.append(known)
    # A fingerprint of many rows makes this side alone skewed, and the join splits it.
    out = marked.join(known, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_sets(nodes: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """(``fp``, ``hashes``), written: the sorted shingle set of each of ``nodes`` (``fp``); ``texts`` has (``fp``, ``text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.sort(shingle_set(t.as_py(), words).view(np.int64)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["fp", "hashes"])

    nodes = cut(nodes.distinct())
    # Up to a million nodes are 8 MB.
    chosen = texts.join(F.broadcast(nodes) if nodes.count() <= 1_000_000 else nodes, "fp").groupBy("fp").agg(F.first("text").alias("text"))
    return cut(chosen.mapInArrow(run, "fp long, hashes array<long>"))


def verified(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The (``a``, ``b``) whose shingle sets have a Jaccard similarity of ``similarity`` or more, written; ``texts`` has (``fp``, ``text``)."""
    pairs = cut(pairs.select("a", "b").distinct())
    sets = shingle_sets(pairs.select(F.explode(F.array("a", "b")).alias("fp")), texts, words)
    side = lambda n: sets.select(F.col("fp").alias(n), F.col("hashes").alias(f"_{n}")).hint("merge")
    both = F.size(F.array_intersect("_a", "_b"))
    return cut(pairs.join(side("a"), "a").join(side("b"), "b").filter(both >= similarity * (F.size("_a") + F.size("_b") - both)).select("a", "b"))


def measured(docs: DataFrame, text_col: str, words: int, similarity: float, rows: int) -> DataFrame:
    """``docs`` with ``_nd_row``, ``_nd_fp``, ``_nd_bits`` and ``_nd_keys``, written: a number of its own, the long fingerprint's hash, the fingerprint and the keys of the bands."""
    from xxhash import xxh64_digest

    shape = bands_for(rows, similarity)
    added = T.StructType.fromDDL("_nd_fp long, _nd_bits binary, _nd_keys array<long>")
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py(), words) for t in b.column(at)]
            bits = [bits_of((x[i : i + CHUNK] for i in range(0, len(x), CHUNK)), LANES) for x in sets]
            fps = np.frombuffer(b"".join(map(xxh64_digest, bits)), ">i8").astype(np.int64)
            keys = pa.array([band_keys(x, *shape) for x in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fps), pa.array(bits, pa.binary()), keys], [*b.schema.names, *added.names])

    schema = T.StructType([*docs.schema.fields, *added.fields])
    return cut(docs.mapInArrow(run, schema).withColumn("_nd_row", F.monotonically_increasing_id()))


LANES = 4


def roots(marked: DataFrame, text_col: str, words: int, similarity: float, tile: int) -> DataFrame:
    """(``_nd_fp``, ``_nd_root``) of every long fingerprint of ``measured`` rows that has a similar one."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    radius = round(64 * LANES * share + 3.5 * math.sqrt(64 * LANES * share * (1 - share)))
    distinct = cut(marked.groupBy(F.col("_nd_fp").alias("fp")).agg(F.first("_nd_bits").alias("bits"), F.first("_nd_keys").alias("keys")))
    keyed = distinct.select("fp", "bits", F.posexplode("keys").alias("mask", "key"))
    texts = marked.select(F.col("_nd_fp").alias("fp"), F.col(text_col).alias("text"))
    hot, n_hot = hot_shards(keyed, tile)
    proposed = cut(searched(first_round(keyed, hot, n_hot), radius, True))
    good = verified(proposed, texts, words, similarity)
    # A pair that failed stood for others of its shard.
    failed = proposed.join(good, ["a", "b"], "left_anti").select("mask", "key")
    again = cut(failed.union(hot.select("mask", "key")).distinct())
    n_again = again.count()
    if n_again:
        dealt = cut(second_round(keyed, again, n_again, cut(stars(good)), min(tile, 256)))
        sets = shingle_sets(dealt.select("fp"), texts, words)
        good = good.unionByName(searched_exactly(dealt.join(sets.hint("merge"), "fp").join(distinct.select("fp", "keys").hint("merge"), "fp"), radius, similarity))
    rooted = stars(good)
    return rooted.union(rooted.select("root", "root").distinct()).toDF("_nd_fp", "_nd_root")


def similar_classes(docs: DataFrame, text_col: str = "text", words: int = 5, similarity: float = 0.8, tile: int = 1024) -> tuple[DataFrame, DataFrame]:
    """Rows and classes by the Jaccard similarity of shingle sets, each link verified: ``docs`` with ``_nd_row`` and ``_nd_fp``, written, and (``_nd_row``, ``_nd_root``), equal for rows of one class.

    A pair at the threshold shares a band with a probability of 0.9999 at least. Two sets of
    similarity J have, at equal sizes, the cosine 2J / (1 + J), and a bit differs with the
    probability angle / pi; pairs within that share of the bits plus 3.5 standard deviations (0.9998
    of those at the threshold) count as near. Of each shard's near pairs a spanning forest, nearest first, is verified.
    Where a pair of it fails, and in hot shards, every near pair of different classes of the
    shard is tested exactly, where the members outside its largest class meet all others; only links
    leave the task. Texts of equal long fingerprints are one node.
    """
    marked = measured(docs, text_col, words, similarity, docs.count())
    with swept(docs.sparkSession) as keep:
        rooted = cut(roots(marked, text_col, words, similarity, tile))
        keep.append(rooted)
    return marked, marked.select("_nd_row", "_nd_fp").join(rooted, "_nd_fp", "left").select("_nd_row", F.coalesce("_nd_root", "_nd_fp").alias("_nd_root"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each class: that of the smallest id (null after all), of equal ids any one."""
    rows, classes = similar_classes(docs, text_col, **options)
    first = F.struct(F.col(id_col).isNull(), F.col(id_col), "_nd_fp", "_nd_row")
    kept = rows.select("_nd_row", "_nd_fp", id_col).join(classes, "_nd_row").groupBy("_nd_root").agg(F.min_by("_nd_row", first).alias("_nd_row"))
    # The same join at every size: what is kept grows with the input, so it is never broadcast.
    return rows.join(cut(kept.select("_nd_row")).hint("merge"), "_nd_row", "left_semi").select(*docs.columns)
