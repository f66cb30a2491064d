"""Quality scores: random Fourier features, ridge regression, isotonic calibration.

Statistics of a whole text, standardised and clipped, go through random Fourier
features, which approximate a Gaussian kernel. Each partition sums its part of the
normal equations; the sums, of a fixed size, give the ridge weights. A fifth of the
labelled rows is left for calibration: their raw scores are counted in bins and an
isotonic fit turns a raw score into a probability.

Defined cases: null and empty texts have zero statistics and are scored like others;
rows with a null or missing label don't train; without labels, every score is 0.5;
with one class only, its value; repeated rows and ties get equal scores; a very long text
is measured whole; other input columns are ignored, clashing names too; an empty table gives
an empty one.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

STATISTICS = (
    "log_chars log_words letters digits upper spaces symbols exclamations bars marks "
    "word_length word_spread distinct_words repeats top_word top_pair lines line_length distinct_lines "
    "capitals marked_words compressed"
).split()
BINS = 512
PIECE = 1 << 16


def statistics(text: str | None) -> list[float]:
    """The ``STATISTICS`` of a whole text."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    n = max(1, len(data))
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()
    k = max(1, len(words))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1)
    seen = Counter(words)
    pairs = Counter(zip(words, words[1:]))
    lines = [x for x in data.split(b"\n") if x.strip()]
    upper = count[65:91].sum()
    letters = upper + count[97:123].sum() + count[128:].sum()
    squeeze = zlib.compressobj(1)
    squeezed = sum(len(squeeze.compress(data[i : i + PIECE])) for i in range(0, len(data), PIECE)) + len(squeeze.flush())
    symbols = sum(count[ord(c)] for c in "#$%&*@^~<>{}[]\\_=+/")
    return [
        np.log1p(len(data)), np.log1p(len(words)), letters / n, count[48:58].sum() / n, upper / max(1, letters),
        (count[32] + count[9:14].sum()) / n, symbols / n, count[33] / n, count[124] / k, sum(count[ord(c)] for c in ".,;:?") / k,
        lengths.mean(), lengths.std(), len(seen) / k ** 0.8, sum(v for (a, b), v in pairs.items() if a == b) / k,
        max(seen.values(), default=0) / k, max(pairs.values(), default=0) / k, len(lines) / k, np.log1p(len(data) / max(1, len(lines))), len(set(lines)) / max(1, len(lines)),
        sum(v for w, v in seen.items() if w[:1].isupper()) / k, sum(v for w, v in seen.items() if not w[-1:].isalnum() and w[-1] < 128) / k, squeezed / n,
    ]


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``doc_id``, ``stats``) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([statistics(t.as_py()) for t in b.column(1)], pa.list_(pa.float64()))], ["doc_id", "stats"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, stats array<double>")


class Fourier:
    """Standardising and random features of a Gaussian kernel of width ``width``."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, size: int = 160, width: float = 6.0, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.w = draw.normal(0, 1 / width, (len(mean), size))
        self.b = draw.uniform(0, 2 * np.pi, size)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.spread, -8, 8)
        z = np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b))
        return np.hstack([z, np.ones((len(z), 1))])


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, len(STATISTICS))


def isotonic(total: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The non-decreasing values closest to the bins' shares of ones, by pooling adjacent violators; empty bins take the one before."""
    blocks: list[list[float]] = []
    for t, o in zip(total, ones):
        blocks.append([t, o, 1])
        while len(blocks) > 1 and (blocks[-1][0] == 0 or blocks[-2][0] == 0 or blocks[-2][1] / blocks[-2][0] >= blocks[-1][1] / blocks[-1][0]):
            t2, o2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t2, blocks[-1][1] + o2, blocks[-1][2] + n2]
    return np.concatenate([np.full(int(n), o / t if t else 0.5) for t, o, n in blocks])


class Model:
    def __init__(self, fourier: Fourier | None, weights: np.ndarray | None, curve: np.ndarray | None, constant: float = 0.5):
        self.fourier, self.weights, self.curve, self.constant = fourier, weights, curve, constant

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.fourier(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.fourier is None:
            return np.full(len(stats), self.constant)
        raw = np.clip(self.raw(stats), 0, 1)
        at = np.minimum((raw * BINS).astype(int), BINS - 1)
        # Within equal steps of the curve the raw score keeps the order.
        return np.clip(0.98 * self.curve[at] + 0.02 * raw, 0, 1)


def fit(labelled: DataFrame, folds: DataFrame | None = None, ridge: float = 1e-3, size: int = 160) -> Model:
    """Learns from (``doc_id``, ``stats``, ``label`` 0 or 1); all rows count, in sums of a fixed size.

    Rows whose hashed id leaves 0 modulo 5 calibrate, the others fit the weights.
    """
    rows = cut(labelled.select("stats", "label", (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).alias("later")))
    ends = {(r["later"], r["label"]): r["n"] for r in rows.groupBy("later", "label").agg(F.count("*").alias("n")).collect()}
    seen = {k for _, k in ends}
    if len(seen) < 2:
        return Model(None, None, None, float(seen.pop()) if seen else 0.5)
    moments = rows.select(F.posexplode("stats")).groupBy("pos").agg(F.avg("col").alias("m"), F.stddev_pop("col").alias("s")).orderBy("pos").collect()
    fourier = Fourier(np.array([r["m"] for r in moments]), np.array([r["s"] or 0.0 for r in moments]), size)
    d = size + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d + 1))
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                part = b.slice(i, 2048)
                z, y = fourier(matrix(part.column(0))), part.column(1).to_numpy(zero_copy_only=False).astype(float)
                w = np.where(y > 0, 1.0, balance)
                total += (z * w[:, None]).T @ np.hstack([z, y[:, None]])
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["cell", "value"])

    balance = max(1.0, min(20.0, 0.5 * sum(n for (_, k), n in ends.items() if k == 1) / sum(n for (_, k), n in ends.items() if k == 0)))
    fits = rows.filter("not later") if any(not late for late, _ in ends) else rows
    cells = fits.select("stats", "label").mapInArrow(sums, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toPandas()
    total = np.zeros(d * (d + 1))
    total[cells["cell"].to_numpy()] = cells["value"].to_numpy()
    total = total.reshape(d, d + 1)
    scale = max(1e-12, np.trace(total[:, :d]) / d)
    weights = np.linalg.solve(total[:, :d] + ridge * scale * np.eye(d), total[:, d])
    model = Model(fourier, weights, None)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = np.clip(model.raw(matrix(b.column(0))), 0, 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum((raw * BINS).astype(np.int64), BINS - 1)), b.column(1).cast(pa.int64())], ["bin", "label"])

    late = rows.filter("later") if any(x for x, _ in ends) else rows
    counted = late.select("stats", "label").mapInArrow(binned, "bin long, label long").groupBy("bin").agg(F.count("*").alias("n"), F.sum("label").alias("ones")).collect()
    n, ones = np.zeros(BINS), np.zeros(BINS)
    for r in counted:
        n[r["bin"]], ones[r["bin"]] = r["n"], r["ones"]
    model.curve = isotonic(n, ones)
    return model


def score(measured: DataFrame, model: Model) -> DataFrame:
    """``measured`` without ``stats``, with ``score``."""
    kind = measured.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(matrix(b.column(1))))], ["doc_id", "score"])

    return measured.select("doc_id", "stats").mapInArrow(run, f"doc_id {kind}, score double")
