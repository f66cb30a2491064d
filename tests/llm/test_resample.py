"""Importance resampling: CRC algebra against zlib, the whole draw against a plain version."""

import hashlib
import math
import re
import zlib

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stagehand.llm import resample, tokens

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=30), st.text("aB é9-", max_size=150)), max_size=6))
def test_words_and_crcs_of_runs(texts):
    found = [WORD.findall(low(t)) for t in texts]
    for at, to, data, offsets in tokens.pieces(pa.array(texts, pa.string()), limit=40):
        w = tokens.words(data, offsets, tokens.LETTERED)
        here = [x for ws in found[at:to] for x in ws]
        assert [bytes(tokens.LOWER[data[s:e]]).decode() for s, e in zip(w.starts, w.ends)] == here
        assert w.count.tolist() == [len(ws) for ws in found[at:to]]
        assert len(set(zip(w.hashes().tolist(), here))) == len(set(here)) == len(set(w.hashes().tolist()))
        for n, (bucket, row) in enumerate(resample.features(w, 3, 10_000), 1):
            assert list(zip(bucket.tolist(), row.tolist())) == [(zlib.crc32(" ".join(ws[i : i + n]).encode()) % 10_000, r) for r, ws in enumerate(found[at:to]) for i in range(len(ws) - n + 1)]


def test_a_word_longer_than_a_span(monkeypatch):
    monkeypatch.setattr(tokens, "SPAN", 64)
    text = "x" * 500 + " y " + "x" * 500 + " y"
    ((_, _, data, offsets),) = tokens.pieces(pa.array([text]))
    h = tokens.words(data, offsets, tokens.LETTERED).hashes()
    assert h[0] == h[2] != h[1] == h[3]


def plain(docs, target, least, percent):
    def features(t):
        ws = WORD.findall(low(t))
        return len(ws), [zlib.crc32(x.encode()) % 10_000 for x in [*ws, *(f"{a} {b}" for a, b in zip(ws, ws[1:]))]]

    s, t = [0] * 10_000, [0] * 10_000
    seen = [(i, *features(x)) for i, x in docs]
    for _, _, f in seen:
        for b in f:
            s[b] += 1
    for x in target:
        for b in features(x)[1]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + 10_000) / ((x + 1) * (sum(t) + 10_000)))) for x, y in zip(s, t)]
    rows = []
    for i, n, f in seen:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((n, i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[0] >= least), key=lambda r: (-r[4], r[1] is None, r[1] or 0, r[2], r[3]))
    drawn = able[: percent * len(able) // 100]
    ranked = [(*r[1:], k) for k, r in enumerate(drawn, 1)]
    rest = [(*r[1:], None) for r in able[len(drawn) :]] + [(*r[1:], None) for r in rows if r[0] < least]
    return sorted(ranked + rest, key=repr)


def test_draw_against_plain_version(spark):
    texts = [None, "", "-", "one two", "ONE two", "straße Über " * 30, "a " * 5000, *(" ".join(f"w{(i * j) % 17}" for j in range(i)) for i in range(2, 60))]
    rows = [*enumerate(texts), (3, "one two"), (None, "one two three"), (70, "same words"), (70, "same words"), (71, "w0 w0 w0")]
    target = ["w0 w1 w2 w3", None, "Über straße"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("rank", F.lit(1)).repartition(5)
    for least, percent in ((2, 25), (1, 100), (20, 0)):
        got = resample.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), least=least, percent=percent)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows, target, least, percent)


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert resample.resample(none, some).collect() == []
    assert [tuple(r) for r in resample.resample(some, none, least=1, percent=100).collect()] == plain([(1, "a b c")], [], 1, 100)
