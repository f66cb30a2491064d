"""Exact top-k inner products through a pivot-distance index.

Components become the integers floor(1024 x). Every vector is keyed by its nearest
pivot and its distance from it, in rings (annuli) of equal width; a cell is a pivot's
ring. Pivots come from a sample by id hash of ``max(sample, 16 * pivots)`` rows, and there are
more of them the more vectors there are: ``sqrt(rows)``, at least 32 and at most 4096, so that each
cluster of that many has one, and the driver gets 65,536 sampled vectors at most, as Arrow. Every vector is indexed. A cell's distances and
norms bound its scores for a query q at distance d from the pivot: by the triangle inequality
no vector of the cell is closer to q than the gap between d and the ring, and
|q - x|^2 = |q|^2 + |x|^2 - 2 qx.

First each query reads the cells of the best bounds until they hold ``first`` vectors (10 k);
the k-th best score so far is its threshold. Then it reads the other cells whose bound
reaches the threshold; the rest can't hold a better one. Vectors of a cell are packed
in blocks of about ``pack``, and so are the queries that want a cell, and a request goes to each
block of its cell, so the work is matrix products over a join of packs and a cell may hold any
share of the vectors. What goes to all tasks is the table of cells (at most 4096 * ``rings``
rows) and the pivots; vectors, requests and results are joined by shuffle at every size.

Defined cases: vectors that are null or hold null or non-finite components take no part;
components and scores beyond a long count as the nearest long; shorter vectors count as filled
up with zeros, so an empty one is the zero vector; fewer than k candidates give all; ties go to
the smaller id; rows that repeat an id are candidates each, and of query rows that repeat an id
the one of the smallest bytes is asked; a query's own id is never its candidate; null ids take
no part; more input columns are ignored, whatever their names; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.accumulators import Accumulator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import KEY_SPACE, cut, order_key

EXACT = float(1 << 53)
CELL = "pivot int, ring int"


LONG = (1 << 63) - 1


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of two matrices of longs, by floats where those are exact; beyond a long, the nearest one."""
    wide, long = q.astype(np.float64), x.astype(np.float64)
    most = np.abs(wide).max(initial=0) * np.abs(long).max(initial=0) * q.shape[1]
    if most < EXACT:
        return (wide @ long.T).astype(np.int64)
    if most < 2.0**63:
        return q @ x.T
    return np.clip(q.astype(object) @ x.T.astype(object), -LONG - 1, LONG).astype(np.int64)


class Pivots:
    """The pivots, in floats, each the farthest of the sample from those before."""

    def __init__(self, sample: np.ndarray, pivots: int, rings: int):
        x = np.unique(sample.astype(np.float64), axis=0)
        chosen = [0] if len(x) else []
        near = np.linalg.norm(x - x[0], axis=1) if len(x) else np.zeros(0)
        while len(chosen) < min(pivots, len(x)) and near.max() > 0:  # the farthest from those chosen is next
            chosen.append(int(near.argmax()))
            near = np.minimum(near, np.linalg.norm(x - x[chosen[-1]], axis=1))
        self.points = x[chosen]
        self.lengths = np.linalg.norm(self.points, axis=1)
        self.width = max(1.0, float(near.max(initial=0)) * 1.5 / rings)
        self.rings = rings

    def distances(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        square = (x * x).sum(1)[:, None] + (self.points * self.points).sum(1)[None] - 2 * x @ self.points.T
        return np.sqrt(np.maximum(square, 0))


def unpack(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, np.int64).reshape(-1, width)


def top_k(
    vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, scale: int = 1024, pivots: int | None = None, rings: int = 4, sample: int = 4096, pack: int = 1024, first: int | None = None, read: Accumulator | None = None
) -> DataFrame:
    """(``query_id``, ``rank``, ``vec_id``, ``score``): for each row where ``queries`` holds, the k best of all other rows.

    ``read`` is told how many vectors are compared.
    """
    first = 10 * k if first is None else first
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<double>")
    fine = v.isNotNull() & F.col(id_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(fine).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * float(scale)).cast("long")).alias("v"), queries.alias("asks"))
    dim, n = rows.agg(F.max(F.size("v")), F.count("*")).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not n:
        return spark.createDataFrame([], schema)
    dim = max(1, dim)
    pivots = pivots or max(32, min(4096, round(n**0.5)))
    share = int(KEY_SPACE * min(1.0, max(sample, 16 * pivots) / n))
    drawn = rows.filter(order_key("pivots", F.col("id")) < share).select("v").toArrow()
    drawn = (drawn if drawn.num_rows else rows.select("v").limit(1).toArrow()).column(0).combine_chunks()

    def matrix(column: pa.Array) -> np.ndarray:
        out = np.zeros((len(column), dim), dtype=np.int64)
        out[np.arange(dim) < column.value_lengths().to_numpy()[:, None]] = column.flatten().to_numpy()
        return out

    index = Pivots(matrix(drawn), pivots, rings)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1))
            d = index.distances(x)
            near = d.argmin(axis=1)
            least = d[np.arange(len(x)), near]
            ring = np.minimum(least / index.width, index.rings - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], pa.binary()), b.column(2), pa.array(near.astype(np.int32)), pa.array(ring), pa.array(least), pa.array((x.astype(np.float64) ** 2).sum(1))], ["id", "v", "asks", "pivot", "ring", "d", "norm"])

    indexed = cut(rows.mapInArrow(assign, f"id long, v binary, asks boolean, {CELL}, d double, norm double"))
    cells = indexed.groupBy("pivot", "ring").agg(F.count("*").alias("n"), F.min("d").alias("low"), F.max("d").alias("high"), F.max("norm").alias("norm")).orderBy("pivot", "ring").toPandas()
    at = {c: cells[c].to_numpy() for c in cells.columns}

    # Blocks of a cell: dealt by the hash of the id into parts of about ``pack`` vectors. A row for each cell.
    blocks = F.broadcast(spark.createDataFrame([(int(p), int(r), -(-int(m) // pack)) for p, r, m in zip(at["pivot"], at["ring"], at["n"])], f"{CELL}, parts int"))
    packed = cut(
        indexed.join(blocks, ["pivot", "ring"]).withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")).cast("int"))
        .groupBy("pivot", "ring", "part").agg(F.collect_list(F.struct("id", "v")).alias("m"))
        .select("pivot", "ring", "part", F.transform("m", lambda m: m["id"]).alias("ids"), F.array_join(F.transform("m", lambda m: F.hex(m["v"])), "").alias("hex"))
        .select("pivot", "ring", "part", "ids", F.unhex("hex").alias("vs"))
    )

    def bounds(q: np.ndarray) -> np.ndarray:
        """For each query and cell, no less than any score in it."""
        d = index.distances(q)[:, at["pivot"]]
        square = (q.astype(np.float64) ** 2).sum(1)[:, None]
        # Distances come from differences of squares, so their errors go with the lengths of the vectors.
        error = 1e-6 * (1 + np.sqrt(square) + np.sqrt(at["norm"])[None] + index.lengths[at["pivot"]][None])
        gap = np.maximum(0, np.maximum(at["low"][None] - d, d - at["high"][None]) - error)
        most = np.minimum((square + at["norm"][None] - gap * gap) / 2, np.sqrt(square * at["norm"][None]))
        return np.maximum(most + np.abs(most) * 1e-9 + 1, -(2.0**63))

    step = max(1, min(256, (1 << 22) // max(1, len(cells))))  # queries whose bounds of all cells are held at a time

    def ask(round_: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for start in range(0, whole.num_rows, step):
                    b = whole.slice(start, step)
                    ids = b.column(0).to_numpy()
                    q = np.stack([np.frombuffer(x, np.int64) for x in b.column(1).to_pylist()])
                    bound = bounds(q)
                    order = np.argsort(-bound, axis=1, kind="stable")
                    before = np.cumsum(at["n"][order], axis=1) - at["n"][order]
                    early = np.zeros(bound.shape, dtype=bool)
                    np.put_along_axis(early, order, before < max(first, k + 1), axis=1)
                    wanted = early if round_ == 1 else ~early & (bound >= b.column(2).to_numpy(zero_copy_only=False)[:, None])
                    for c in np.flatnonzero(wanted.any(axis=0)):
                        these = wanted[:, c]
                        yield pa.RecordBatch.from_arrays([pa.array([at["pivot"][c]], pa.int32()), pa.array([at["ring"][c]], pa.int32()), pa.array([ids[these].tobytes()], pa.binary()), pa.array([q[these].tobytes()], pa.binary())], ["pivot", "ring", "qids", "qs"])

        return run

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                qids, q = np.frombuffer(b.column(0)[i].as_py(), np.int64), unpack(b.column(1)[i].as_py(), dim)
                ids, x = np.array(b.column(2)[i].as_py(), dtype=np.int64), unpack(b.column(3)[i].as_py(), dim)
                s = scores(q, x)
                if read is not None:
                    read.add(s.size)
                out: list[list] = [[], [], []]
                for r, qid in enumerate(qids):
                    best = np.lexsort((ids, ~s[r])) if len(ids) <= 4 * k else near_best(s[r], ids, k + 1)
                    best = [j for j in best if ids[j] != qid][:k]
                    out[0] += [int(qid)] * len(best)
                    out[1] += ids[best].tolist()
                    out[2] += [int(y) for y in s[r][best]]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["query_id", "vec_id", "score"])

    def near_best(row: np.ndarray, ids: np.ndarray, many: int) -> np.ndarray:
        # A repeated id may be the query's own several times, so all of the last score and all of the own id stay.
        cutoff = np.partition(row, len(row) - many)[len(row) - many]
        while True:
            chosen = np.flatnonzero(row >= cutoff)
            if len(np.unique(ids[chosen])) >= many or len(chosen) == len(row):
                return chosen[np.lexsort((ids[chosen], ~row[chosen]))]
            many = min(len(row), 2 * many)
            cutoff = np.partition(row, len(row) - many)[len(row) - many]

    def searched(asked: DataFrame) -> DataFrame:
        requests = asked.join(blocks, ["pivot", "ring"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        pairs = requests.join(packed.hint("merge"), ["pivot", "ring", "part"]).select("qids", "qs", "ids", "vs")
        return pairs.mapInArrow(score, "query_id long, vec_id long, score long")

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    request = f"{CELL}, qids binary, qs binary"
    asking = indexed.filter("asks").groupBy("id").agg(F.min("v").alias("v")) if k else indexed.limit(0)
    asking = cut(asking)
    opening = cut(best(searched(asking.select("id", "v").mapInArrow(ask(1), request))).select("query_id", "vec_id", "score", "rank"))
    # Until a query has k, nothing may be left out.
    thresholds = opening.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("s")).filter(F.col("n") == k)
    second = asking.join(thresholds.hint("merge"), F.col("id") == F.col("query_id"), "left").select("id", "v", F.coalesce(F.col("s").cast("double"), F.lit(float("-inf"))).alias("s"))
    rest = searched(second.mapInArrow(ask(2), request))
    out = best(opening.select("query_id", "vec_id", "score").unionByName(rest))
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
