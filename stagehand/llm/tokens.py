"""Words of whole columns of texts as arrays: where each begins and ends, and a 64-bit hash of it.

Texts stay UTF-8 bytes. A class of single bytes tells what belongs to a word; every byte of a
character beyond ASCII does. Memory goes with the bytes of a batch's piece (``pieces``), or of
the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes that are hashed at a time.
SPAN = 1 << 20
#: An odd multiplier and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 1 << 64)


def byte_class(outside: str) -> np.ndarray:
    """Which bytes belong to words, given the ASCII characters that don't."""
    inside = np.ones(256, dtype=bool)
    inside[[ord(c) for c in outside]] = False
    return inside


#: Words end at ASCII white space.
SPACED = byte_class(" \t\n\x0b\x0c\r")
#: Words are ASCII letters and digits and all beyond ASCII.
LETTERED = byte_class("".join(chr(c) for c in range(128) if not chr(c).isalnum()))
#: Bytes with A-Z lower-cased.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: A random-looking number for each byte, equal for both cases of A-Z.
CODES = mix(np.arange(1, 257, dtype=U) * U(BASE))[LOWER]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U)
    out[:1] = 1
    return np.multiply.accumulate(out)


FORTH, HOME = _powers(BASE, SPAN + 1), _powers(BACK, SPAN + 1)


class Words(NamedTuple):
    """Words of consecutive texts. ``count``: how many each text has."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    count: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, A-Z lower-cased."""
        out = np.empty(len(self.starts), dtype=U)
        at = 0
        while at < len(out):
            low = self.starts[at]
            to = max(at + 1, int(np.searchsorted(self.ends, low + SPAN, side="right")))
            span = self.data[low : self.ends[to - 1]]
            forth, home = (FORTH, HOME) if len(span) <= SPAN else (_powers(BASE, len(span)), _powers(BACK, len(span)))
            total = np.zeros(len(span) + 1, dtype=U)
            np.cumsum(CODES[span] * forth[: len(span)], out=total[1:])
            s, e = self.starts[at:to] - low, self.ends[at:to] - low
            out[at:to] = mix((total[e] - total[s]) * home[s] + (e - s).astype(U))
            at = to
        return out


def pieces(column: pa.Array, limit: int = 1 << 22) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offset of each row in them) of runs of rows of about ``limit`` bytes."""
    column = pc.fill_null(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, "")
    if not len(column):
        return
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Words:
    """The words of texts that lie one behind another."""
    word = inside[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    begins[first] = word[first]  # a word ends with its text
    starts = np.flatnonzero(begins)
    over = np.zeros(len(data) + 1, dtype=bool)
    over[1:-1] = word[:-1] & (~word[1:] | begins[1:])
    if len(data):
        over[-1] = word[-1]
    return Words(data, starts, np.flatnonzero(over), np.diff(np.searchsorted(starts, offsets)))
