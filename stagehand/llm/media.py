"""Media columns: texts as WAV audio, with spectral-peak pair fingerprints.

A text's UTF-8 bytes, padded with zero bytes to a positive multiple of 64, are the
unsigned 8-bit samples of a mono WAV file. The file is read back by the wave module.
Features come from a short-time Fourier transform: in each of four frequency bands
the strongest bin of a frame is a peak if it stands above the same band's in the
frames before and after. Each peak is paired with the next two; a pair's two bins and
distance in time make a hash, stored with the first peak's frame as a time code.

A text is transformed alone, in blocks of frames, so equal texts have equal features
and memory doesn't grow with a text. Magnitudes are rounded to quarter decibels before
they are compared.

Defined cases: a null text is an empty one, 64 zero bytes; a text shorter than a frame
is one frame; a constant frame has its peaks at the lowest bin of each band; a very long
text is stored and transformed whole; repeated rows and equal texts get equal values; other
input columns are ignored, clashing names too; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAD, RATE, FRAME, HOP, BLOCK = 64, 8000, 512, 256, 2048
BANDS = (1, 16, 48, 112, 257)
FAN, REACH = 2, 16
SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, peak_time array<int>, peak_hash array<int>"


def to_wav(data: bytes) -> bytes:
    """The stored form of the bytes."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(data + bytes(-len(data) % PAD or (0 if data else PAD)))
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    """The payload of a stored form."""
    with wave.open(io.BytesIO(stored), "rb") as w:
        return w.readframes(w.getnframes())


def levels(samples: np.ndarray) -> Iterator[np.ndarray]:
    """Quarter decibels of the spectrum of each frame, a block of frames at a time."""
    frames = max(1, -(-(len(samples) - FRAME) // HOP) + 1)
    window = np.hanning(FRAME)
    for i in range(0, frames, BLOCK):
        n = min(BLOCK, frames - i)
        part = samples[i * HOP : (i + n - 1) * HOP + FRAME].astype(np.float64) / 128 - 1
        part = np.pad(part, (0, (n - 1) * HOP + FRAME - len(part)))
        cut = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP]
        spectrum = np.abs(np.fft.rfft(cut * window, axis=1))
        yield np.rint(80 * np.log10(spectrum + 1e-6)).astype(np.int32)


def peak_pairs(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Time codes and hashes of the pairs of peaks."""
    at, height = [], []
    for block in levels(np.frombuffer(payload, np.uint8)):
        bands = [block[:, a:b] for a, b in zip(BANDS, BANDS[1:])]
        at.append(np.stack([b.argmax(axis=1) + a for a, b in zip(BANDS, bands)], axis=1))
        height.append(np.stack([b.max(axis=1) for b in bands], axis=1))
    at, height = np.concatenate(at), np.concatenate(height)
    edge = np.full((1, height.shape[1]), np.iinfo(np.int32).min)
    peak = (height > np.concatenate([edge, height[:-1]])) & (height >= np.concatenate([height[1:], edge]))
    time, band = np.nonzero(peak)
    bins = at[time, band]
    times, hashes = [], []
    for k in range(1, FAN + 1):
        apart = time[k:] - time[:-k]
        near = apart <= REACH
        times.append(time[:-k][near])
        hashes.append((bins[:-k][near] << 14) | (bins[k:][near] << 5) | apart[near])
    times, hashes = np.concatenate(times), np.concatenate(hashes)
    order = np.lexsort((hashes, times))
    return times[order].astype(np.int32), hashes[order].astype(np.int32)


def describe(text: str | None) -> tuple:
    """The columns of ``SCHEMA`` for a text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    stored = to_wav(data)
    payload = from_wav(stored)
    times, hashes = peak_pairs(payload)
    feature = " ".join(map("%x:%x".__mod__, zip(times.tolist(), hashes.tolist())))
    return len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, times, hashes


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = False) -> DataFrame:
    """The id and ``SCHEMA`` of every row; ``with_bytes`` adds the stored form as ``media``."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, {SCHEMA}" + ", media binary" * with_bytes
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                b = whole.slice(start, 256)
                texts = b.column(1).to_pylist()
                columns = [pa.array(c, t) for c, t in zip(zip(*map(describe, texts)), types)]
                if with_bytes:
                    columns.append(pa.array([to_wav((t or "").encode("utf-8", "surrogatepass")) for t in texts], pa.binary()))
                yield pa.RecordBatch.from_arrays([b.column(0), *columns], names)

    return docs.select(F.col(id_col), F.col(text_col).alias("_text")).mapInArrow(run, schema)
