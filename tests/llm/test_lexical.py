"""Ranked search against a plain version."""

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from stagehand.llm import lexical

TERM = re.compile(lexical.TERM)


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    held = [(i if i is not None else lexical.LAST, terms(t)) for i, t in docs]
    held = [(i, Counter(ws), len(ws)) for i, ws in held if ws]
    n, total = len(held), sum(x[2] for x in held)
    df = Counter(w for _, c, _ in held for w in c)
    weight = {w: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for w, d in df.items()}
    out = []
    for item, text in items:
        scored = []
        for i, c, many in held:
            m = 100 - 75 + (75 * many * n) // total
            if (s := sum(weight[t] * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)) > 0:
                scored.append((-s, i))
        out += [(item, r, None if i == lexical.LAST else i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("terms", F.lit(1)).repartition(3)
    return sorted((tuple(r) for r in lexical.top_documents(d, spark.createDataFrame(items, "item_id long, text string"), **kw).collect()), key=repr)


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    return [(i, " ".join(rng.choices(vocabulary, weights=[1 / (j + 1) for j in range(60)], k=rng.choice((1, 3, 20, 200))))) for i in rng.sample(range(10_000), n)]


def test_against_plain_version(spark):
    docs = corpus(1, 150)
    docs += [(-5, None), (20_001, ""), (20_002, "--"), (20_003, "Über ÜBER Straße w59 w58"), (None, "w59 w58 w57"), (7, "w59 " * 30_000), *[(30_000 + i, "copy w59 w40 w3") for i in range(60)], (30_000, "copy w59 w40 w3"), (30_000, "w1")]
    items = [(1, "w0 w59 w59 w3 Copy"), (2, None), (3, "nothing here"), (4, "über straße"), (None, "w58"), (5, " ".join(f"w{i}" for i in range(60))), (6, "w0")]
    for kw in ({}, {"tokens": 300}, {"tokens": 1}, {"block": 30}, {"k": 1}, {"k": 500}):
        assert found(spark, docs, items, **kw) == plain(docs, items, kw.get("k", 10))


def test_repeated_items_ask_the_smallest_text(spark):
    docs = corpus(2, 20)
    assert found(spark, docs, [(1, "w5"), (1, "w4"), (1, None)]) == plain(docs, [(1, "w4")])


def test_empty_tables_and_one_document(spark):
    assert found(spark, [], [(1, "a")]) == [] == found(spark, [(1, "a b")], []) == found(spark, [(1, None)], [(1, "a")])
    assert found(spark, [(3, "a b")], [(1, "a z")]) == plain([(3, "a b")], [(1, "a z")]) != []


def test_bounds_leave_nodes_out():
    """A rare term's documents are reached through few of a shard's nodes; the answer is the same."""
    rng = np.random.default_rng(3)
    n = 4000
    count = rng.integers(5, 40, n)
    common = rng.integers(0, 50, count.sum()).astype(np.uint64)
    hashes = common.copy()
    ends = np.cumsum(count)
    hashes[ends[::300] - 1] = 99
    tree = lexical.opened(dict(zip(["ids", "terms", "starts", "impacts", "bits"], lexical.shard(np.arange(n), count, hashes, n, int(count.sum())))))
    assert tree.depth == 12 and len(tree.ids) == n
    asked = np.array([3, 99], dtype=np.uint64)
    at = np.searchsorted(tree.terms, asked)
    best = lexical.Best(10)
    taken = lexical.search(tree, np.array([300, 6000]), tree.starts[at], tree.starts[at + 1], best)
    assert taken < n / 2
    score = np.zeros(n, np.int64)
    tf = np.zeros((2, n), np.int64)
    for row, term in enumerate(asked):
        tf[row] = np.bincount(np.repeat(np.arange(n), count)[hashes == term], minlength=n)
    m = 25 + (75 * count * n) // count.sum()
    for row, w in enumerate((300, 6000)):
        score += np.where(tf[row] > 0, w * (1_000_000_000 * tf[row] // (1000 * tf[row] + 8 * m)), 0)
    expected = sorted(range(n), key=lambda i: (-score[i], i))[:10]
    assert best.ids.tolist() == expected and best.scores.tolist() == score[expected].tolist()
