"""The n-gram model against a plain version that keeps words in dictionaries."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stagehand.llm import lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")
END, START = ("end",), ("start",)


def tokens(text):
    return [*WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")), END]


class Plain:
    def __init__(self, texts, order):
        self.order, self.texts = order, [tokens(t) for t in texts]
        self.words = Counter(w for ws in self.texts for w in ws)
        self.count = {order: Counter(tuple(s[i - order : i]) for ws in self.texts for s in [[START] * (order - 1) + ws] for i in range(order, len(s) + 1))}
        for n in range(order - 1, 0, -1):
            self.count[n] = Counter(g[1:] for g in self.count[n + 1])
        self.context = {n: defaultdict(list) for n in self.count}
        for n, c in self.count.items():
            for g, x in c.items():
                self.context[n][g[:-1]].append(x)
        self.lost = {n: lm.discounts([sum(x == k for x in c.values()) for k in (1, 2, 3, 4)]) for n, c in self.count.items()}

    def p(self, gram):
        if not gram:
            return 1 / (len(self.words) + 1)
        n = len(gram)
        seen = self.context[n].get(gram[:-1])
        if not seen:
            return self.p(gram[1:])
        d, a = self.lost[n], self.count[n][gram]
        return (max(a - d[min(a, 3)], 0) + sum(d[min(x, 3)] for x in seen) * self.p(gram[1:])) / sum(seen)

    def score(self, text):
        s = [START] * (self.order - 1) + tokens(text)
        n, v = sum(self.words.values()), len(self.words)
        ws = tokens(text)
        base = sum(math.log10((self.words[w] + 1) / (n + 1 * (v + 1))) for w in ws)
        return len(ws), sum(self.words[w] > 0 for w in ws), n, base, sum(math.log10(self.p(tuple(s[i - self.order : i]))) for i in range(self.order, len(s) + 1))


def corpus(seed=1):
    rng = random.Random(seed)
    texts = [" ".join(f"w{min(int(rng.expovariate(0.15)), 40)}" for _ in range(rng.choice((1, 2, 9, 60)))) for _ in range(120)]
    return [*texts, None, "", " \n\t", "Straße ÜBER straße", "W1 w1", "W1 w1", "same w2 " * 3000, "x" * 5000]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_against_plain_version(spark, monkeypatch, order):
    texts, unseen = corpus(), ["w1 w2 never seen w3", "NEVER", None, "w9 w8 w7 w6 w5"]
    monkeypatch.setattr(lm, "BYTE", 20)
    plain = Plain(texts, order)
    rows = [(i, t, True) for i, t in enumerate(texts)] + [(1000 + i, t, False) for i, t in enumerate(unseen)] + [(None, "w1 w2", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, train boolean").withColumn("score", F.lit("clash")).repartition(3)
    model = lm.fit(docs, F.col("train"), order, shards=5)
    got = {r["doc_id"]: r for r in lm.score(docs, model).collect()}
    assert len(got) == len(rows) and model.distinct == len(plain.words)
    for i, text, _ in rows:
        r, e = got[i], plain.score(text)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == e[:3]
        assert r["base_score"] == pytest.approx(e[3], rel=1e-9) and r["score"] == pytest.approx(e[4], rel=1e-9)
        assert r["perplexity"] == pytest.approx(10 ** (-e[4] / e[0]), rel=1e-9)
    for context in ((), (START,), ("w1",), ("w5",)):  # probabilities of all words and one unknown sum to 1
        if len(context) < order:
            pad = (START,) * (order - 1 - len(context)) + context
            assert sum(plain.p((*pad, w)) for w in [*plain.words, "unknown"]) == pytest.approx(1)


def test_slices_of_long_texts(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(corpus(2))], "doc_id long, text string")
    model = lm.fit(docs, F.lit(True), 3)
    whole = {r["doc_id"]: r["score"] for r in lm.score(docs, model).collect()}
    arrays = lm.Mapped(model)
    for i, text in enumerate(corpus(2)):
        ((_, _, data, offsets),) = lm.pieces(pa.array([text], pa.string()))
        w = lm.words(data, offsets, lm.SPACED)
        _, place = arrays.counts(0, w.hashes())
        seq, first = lm.sequence(place.astype(np.uint64) + np.uint64(lm.WORDS), w.count, 3)
        total = 0.0
        for low in range(0, len(seq), 7):
            p = np.arange(max(low, 2), min(low + 7, len(seq)))
            total += lm.logs(arrays, seq, p[lm._predicted(p, first, w.count)]).sum()
        assert total == pytest.approx(whole[i], rel=1e-9)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = lm.score(docs, lm.fit(docs, F.lit(False))).collect()
    assert {(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["score"]) for r in got} == {(1, 3, 0, 0, 0.0), (2, 1, 0, 0, 0.0)}
    empty = docs.limit(0)
    assert lm.score(empty, lm.fit(empty, F.lit(True))).collect() == []


def test_the_folder_must_be_mounted():
    assert lm.mounted("file:///a/b") == "/a/b" == lm.mounted("/a/b")
    with pytest.raises(RuntimeError):
        lm.mounted("hdfs://host/a")
