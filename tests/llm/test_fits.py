"""The fits of the quality and language models against plain solutions of the problems that they state."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stagehand.llm import langid, quality

from .test_operators import docs


def plain_isotonic(total, ones):
    """Of each bin the greatest over starts of the least over ends of the share between; empty bins take the one before."""
    some = np.flatnonzero(total)
    t, o = np.concatenate([[0], np.cumsum(total[some])]), np.concatenate([[0], np.cumsum(ones[some])])
    value = [max(min((o[k + 1] - o[j]) / (t[k + 1] - t[j]) for k in range(i, len(some))) for j in range(i + 1)) for i in range(len(some))]
    return dict(zip(some.tolist(), value))


def test_quality_is_a_ridge_fit_with_an_isotonic_curve(spark):
    rng = random.Random(11)
    words = "time year people way day man thing woman life child world school state family student".split()
    good = lambda: ". ".join(" ".join(rng.choice(words) for _ in range(9)).capitalize() for _ in range(rng.randrange(1, 8))) + "."
    bad = lambda: " ".join(rng.choice(("!!!", "BUY", "$$$", "now", *words[:4])) for _ in range(rng.randrange(5, 60)))
    texts = [good() if (i % 2) ^ (rng.random() < 0.1) else bad() for i in range(400)]
    measured = quality.measure(docs(spark, texts)).cache()
    labelled = measured.withColumn("label", F.col("doc_id") % 2)
    model = quality.fit(labelled, size=40)
    rows = labelled.withColumn("later", F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).orderBy("doc_id").collect()
    x, y, later = np.array([r["stats"] for r in rows]), np.array([r["label"] for r in rows], float), np.array([r["later"] for r in rows])
    assert model.fourier.mean == pytest.approx(x.mean(axis=0)) and model.fourier.spread == pytest.approx(np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1.0))
    z = model.fourier(x[~later])
    w = np.where(y[~later] > 0, 1.0, max(1.0, min(20.0, 0.5 * (y == 1).sum() / (y == 0).sum())))
    scale = (w[:, None] * z * z).sum() / z.shape[1]
    tall = np.vstack([z * np.sqrt(w)[:, None], np.sqrt(1e-3 * scale) * np.eye(z.shape[1])])
    plain = np.linalg.lstsq(tall, np.concatenate([y[~later] * np.sqrt(w), np.zeros(z.shape[1])]), rcond=None)[0]
    assert model.raw(x) == pytest.approx(model.fourier(x) @ plain, abs=1e-6)
    raw = np.clip(model.raw(x[later]), 0, 1)
    at = np.minimum((raw * quality.BINS).astype(int), quality.BINS - 1)
    total, ones = np.bincount(at, minlength=quality.BINS), np.bincount(at, y[later], minlength=quality.BINS)
    for b, share in plain_isotonic(total, ones).items():
        assert model.curve[b] == pytest.approx(share)
    assert (np.diff(model.curve) >= 0).all()


def newton(x, y, weight, penalty):
    """The least of penalty / 2 |w|^2 + sum of weight max(0, 1 - y wx)^2, by Newton's steps on the rows inside the margin."""
    w = np.zeros(x.shape[1])
    for _ in range(60):
        inside = y * (x @ w) < 1
        a = x[inside]
        new = np.linalg.solve(penalty * np.eye(len(w)) + 2 * (a * weight[inside, None]).T @ a, 2 * a.T @ (weight[inside] * y[inside]))
        if np.allclose(new, w, atol=1e-12):
            break
        w = (w + new) / 2 if _ % 7 == 6 else new
    return w


def test_language_machines_are_at_their_least(spark):
    rng = np.random.default_rng(5)
    for n, shift in ((60, 1.0), (90, 0.3)):
        y = np.where(np.arange(n) % 3 == 0, 1.0, -1.0)
        x = rng.normal(size=(n, 12)) + shift * y[:, None] * np.eye(12)[0]
        x /= np.linalg.norm(x, axis=1)[:, None]
        kernel = x @ x.T
        weight = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())
        cost = lambda w: 0.5 * 1e-3 * w @ w + (weight * np.maximum(0, 1 - y * (x @ w)) ** 2).sum()
        found, best = langid.fit_svm(kernel, y) @ x, newton(x, y, weight, 1e-3)
        assert cost(found) <= cost(best) * 1.01 + 1e-9
        assert np.mean(np.sign(x @ found) == np.sign(x @ best)) >= 0.98
