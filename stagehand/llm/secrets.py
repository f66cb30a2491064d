"""Secret scans: fixed patterns, and a token-efficiency test for random strings.

Base spans are assignments, access keys and long hex runs, each leftmost and without
overlap within its kind. The method adds runs of key characters that a tokenizer's
vocabulary compresses badly: words give three or more characters a token, random strings
fewer than two. Every run of ``LEAST`` characters or more outside base spans is tested,
letters alone too. Left out before the test are known digests (hex of a digest's length,
with their prefixes), UUIDs, runs without a letter, and identifiers: runs whose pieces
between separators and humps are mostly single tokens or long for their tokens. A run is
random if it has at most ``ratio - 3.2 / length`` characters a token, as short runs spread
more. A run of letters alone also is a word, whatever the vocabulary makes of it, if its letters follow one
another as the corpus' do: the pairs of letters of all texts are counted first (a table of 27 by 27), and the mean log
probability of its pairs must come nearer to the corpus' than to that of letters drawn alike. Every step is linear in the text.

The vocabulary is a tiktoken file at ``vocabulary``, else the path in the session's
``spark.stagehand.vocabulary``, else ``VOCABULARY``; the driver reads it and its bytes (under
1 MB) go with the tasks, so executors need no copy. It is never trained.

Defined cases: a null text is an empty one, with zero counts and no spans; whole texts are
scanned, whatever their length; repeated rows get equal spans; an empty table gives an
empty one; other input columns are ignored, clashing names too.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import LOWER, pieces

KINDS = ("assign", "access", "hex")
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed patterns. A run is as long as it can be, so a least length may stand in the pattern.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
DIGEST = re.compile(r"(?:(?:md5|sha1|sha224|sha256|sha384|sha512)[-:=_]?)?(?:[0-9A-Fa-f]{32}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{56}|[0-9A-Fa-f]{64}|[0-9A-Fa-f]{96}|[0-9A-Fa-f]{128})|sha(?:256|384|512)-[A-Za-z0-9+/]+=*")
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
PIECE = re.compile(r"[A-Za-z0-9]+")
HUMP = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[A-Z]|[0-9]+")
LEAST, RATIO = 16, 2.2
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def encoder(vocabulary: bytes) -> Callable[[str], int]:
    """Number of tokens of a string under a tiktoken vocabulary."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    encoding = tiktoken.Encoding("secrets", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda s: len(encoding.encode_ordinary(s))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end), sorted."""
    spans = []
    if ":" in text or "=" in text:
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def is_identifier(run: str, tokens: Callable[[str], int], ratio: float) -> bool:
    """Whether four fifths of a run's letters are in words: pieces of one token, or humps of three letters or more that compress well; capitals count as if small."""
    letters = words = 0
    for piece in PIECE.findall(run):
        plain = piece.rstrip("0123456789")
        if plain.isalpha() and len(plain) < 8 and len(piece) - len(plain) <= 4 and tokens(plain.lower() if plain.isupper() else plain) == 1:
            letters, words = letters + len(plain), words + len(plain)
            continue
        for hump in HUMP.findall(piece):
            if hump[0].isalpha():
                letters += len(hump)
                if len(hump) > 2 and len(hump) >= ratio * tokens(hump.lower() if hump.isupper() else hump):
                    words += len(hump)
    return 5 * words >= 4 * letters


class Letters:
    """How letters follow one another in a corpus: counts of pairs of letters (26: anything else)."""

    def __init__(self, counts: np.ndarray):
        pairs = counts.reshape(27, 27)[:26, :26].astype(float)
        self.logs = np.log2((pairs + 1) / (pairs + 1).sum(axis=1, keepdims=True))
        usual = (pairs * self.logs).sum() / max(1.0, pairs.sum())
        self.least = (usual + self.logs.mean()) / 2

    def like(self, run: str) -> bool:
        """Whether a run of letters reads like the corpus' words."""
        at = LOWER[np.frombuffer(run.encode(), np.uint8)].astype(int) - 97
        return len(at) > 1 and self.logs[at[:-1], at[1:]].mean() >= self.least


PLACE = np.full(256, 26)
PLACE[97:123] = PLACE[65:91] = np.arange(26)


def letter_pairs(texts: DataFrame) -> np.ndarray:
    """Counts of the pairs of letters of a table's ``text``; a task sends one row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(27 * 27, dtype=np.int64)
        for b in batches:
            for _, _, data, offsets in pieces(b.column(0)):
                at = PLACE[data]
                pairs = at[:-1] * 27 + at[1:]
                ends = offsets[1:-1]
                pairs[ends[(ends > 0) & (ends < len(data))] - 1] = 27 * 27 - 1  # a text ends between
                total += np.bincount(pairs, minlength=27 * 27)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(27 * 27)), pa.array(total)], ["pair", "n"])

    out = np.zeros(27 * 27, dtype=np.int64)
    for r in texts.mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[r["pair"]] = r["n"]
    return out


def random_runs(text: str, base: list[tuple[int, int, int]], tokens: Callable[[str], int], ratio: float, letters: Letters | None = None) -> list[tuple[int, int]]:
    """Runs that the token-efficiency test exposes; ``base`` is sorted."""
    out, at, reach = [], 0, 0  # the next base span, and the furthest end of those before it
    for m in RUN.finditer(text):
        run, start, end = m.group(), m.start(), m.end()
        while at < len(base) and base[at][0] < end:
            reach = max(reach, base[at][2])
            at += 1
        if reach > start or not any(c.isalpha() for c in run) or DIGEST.fullmatch(run) or UUID.fullmatch(run):
            continue
        if run.isalpha() and (text[start - 1 : start].isalpha() or text[end : end + 1].isalpha()):
            continue  # a piece of a word with letters beyond ASCII
        least = ratio - 3.2 / len(run)
        if not is_identifier(run, tokens, least) and len(run) <= least * tokens(run) and not (letters and run.isalpha() and letters.like(run)):
            out.append((start, end))
    return out


def describe(text: str | None, tokens: Callable[[str], int], ratio: float = RATIO, letters: Letters | None = None) -> tuple:
    """The columns of ``SCHEMA``."""
    text = text or ""
    base = base_spans(text)
    shown = [f"{KINDS[k]}:{s}:{e}" for s, k, e in base]
    every = sorted([*base, *((s, 3, e) for s, e in random_runs(text, base, tokens, ratio, letters))])
    spans = ",".join(f"{(*KINDS, 'random')[k]}:{s}:{e}" for s, k, e in every)
    return *(sum(k == i for _, k, _ in base) for i in range(3)), hashlib.sha256(",".join(shown).encode()).hexdigest(), spans


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, ratio: float = RATIO) -> DataFrame:
    """The id and ``SCHEMA`` of every row."""
    with open(vocabulary or docs.sparkSession.conf.get("spark.stagehand.vocabulary", VOCABULARY), "rb") as f:
        ranks = f.read()
    kind = docs.schema[id_col].dataType.simpleString()
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = [id_col, *(x.split()[0] for x in SCHEMA.split(", "))]

    letters = Letters(letter_pairs(docs.select(F.col(text_col).cast("string").alias("text"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = None
        for b in batches:
            tokens = tokens or encoder(ranks)
            rows = [describe(t.as_py(), tokens, ratio, letters) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), types))] if rows else [b.column(0), *(pa.array([], t) for t in types)], names)

    return docs.select(F.col(id_col), F.col(text_col).alias("_text")).mapInArrow(run, f"{id_col} {kind}, {SCHEMA}")
