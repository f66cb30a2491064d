"""Small cases of every operator: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stagehand.llm import langid, media, mixing, packing, pii, quality, secrets, simhash, topk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["s"])[i % len(sources or ["s"])], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta eta".split()) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    return docs(spark, [None, "", " \n", "x", "x", "long " * 20000, *texts], ["a", "b", None])


def test_boundaries_are_optimal():
    rng = random.Random(1)
    for _ in range(40):
        lengths = sorted(rng.sample(range(1, 60), 9))
        histogram = [(x, n := rng.randrange(1, 9), n * x) for x in lengths]
        pad = lambda ends: sum(n * min(e for e in ends if e >= x) - t for x, n, t in histogram)
        best = min(pad((*c, lengths[-1])) for c in itertools.combinations(lengths[:-1], 2))
        assert pad(packing.boundaries(histogram, 3)) == best


def test_packing(spark, mixed):
    got = packing.pack(mixed.withColumn("bucket", F.lit(1)), keep=("bucket", "source"), buckets=4, budget=256).collect()
    assert len(got) == 66 and len({(r["batch"], r["slot"]) for r in got}) == 66
    for _, rows in itertools.groupby(sorted(got, key=lambda r: r["batch"]), key=lambda r: r["batch"]):
        rows = list(rows)
        assert len(rows) == 1 or len(rows) * rows[0]["bucket_len"] <= 256 or rows[0]["bucket_len"] == 0
    assert packing.pack(mixed.limit(0)).count() == 0


def test_mixing(spark, mixed):
    got = mixing.mix(mixed.withColumn("size", F.lit("clash"))).drop("text").collect()
    assert len(got) == 66 and all(r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"]) for r in got)
    assert sum(r["taken"] for r in got) <= sum(r["size"] for r in got)
    assert abs(sum({r["source"]: r["target"] for r in got}.values()) - sum(r["size"] for r in got)) < 1e-6
    assert mixing.mix(mixed.limit(0)).count() == 0
    assert mixing.mixed_documents(mixed).columns == mixed.columns


def test_media_round_trip(spark):
    texts = [None, "", "é" * 33, "a" * 64, "tone " * 5000, "tone " * 5000]
    got = {r["doc_id"]: r for r in media.media(docs(spark, texts), with_bytes=True).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        padded = data + bytes(-len(data) % 64 or (0 if data else 64))
        assert media.from_wav(got[i]["media"]) == padded and got[i]["n_bytes"] == len(data)
        assert got[i]["payload_sha256"] == hashlib.sha256(padded).hexdigest()
    assert got[4]["feature"] == got[5]["feature"] != ""


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_pii(t):
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    good = [lambda v: True, lambda v: all(int(p) <= 255 for p in v.split(".")), lambda v: 14 <= len(re.sub(r"\D", "", v)) <= 19 and luhn(re.sub(r"\D", "", v)), lambda v: 10 <= len(re.sub(r"\D", "", v)) <= 15]
    return sorted((m.start(), i, m.end()) for i, p in enumerate(patterns) for m in re.finditer(p, t or "") if good[i](m.group()))


def test_pii_base_spans(spark):
    rng = random.Random(3)
    bits = ["a@b.c", "x.y_z@d-e.fr", "@", ".", "_q@r.s", "1.2.3.4", "256.1.1.1", ".5", "4111111111111111", "4111 1111-1111 1111", " ", "+1 (234) 555-7890", "é", "9" * 25, "-", "00.001.2.3", "+", "7"]
    texts = [None, "", "1" * 60000, "a" * 60000, "a@b.c " * 300, *("".join(rng.choice(bits) for _ in range(14)) for _ in range(150))]
    for r in pii.report(docs(spark, texts)).collect():
        want = brute_pii(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in want).encode()).hexdigest(), texts[r["doc_id"]][:300]


def test_pii_discloses_and_masks(spark):
    texts = [f"note {i} from Zanzibarov at z@y.org about things" for i in range(4)] + [f"note {i} about things from others" for i in range(40)] + [None]
    table = docs(spark, texts)
    spans = {r["doc_id"]: r["spans"] for r in pii.report(table).collect()}
    assert "removed:12:22" in spans[0].split(",")
    assert spans[10] == ""
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(table).collect()}
    assert "[EMAIL]" in clean[0] and "Zanzibarov" not in clean[0] and "things" in clean[0]
    assert clean[10] == texts[10] and clean[44] is None
    assert pii.report(table.limit(0)).count() == 0


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(400)] + [(i, [0.5] * 6) for i in range(400, 420)] + [(500, None), (501, [1.0, None]), (502, [float("nan")] * 6), (503, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    good = {i: np.floor(1024 * np.array(v, dtype=np.float32).astype(float)).astype(int) for i, v in rows if v and None not in v and v[0] == v[0]} | {503: np.zeros(6, int)}
    got = {}
    for r in topk.top_k(table, F.col("vec_id") % 50 == 0, k=5, pivots=4, rings=3, pack=32, first=20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in [i for i in good if i % 50 == 0]:
        want = sorted((-int(good[q] @ v), i) for i, v in good.items() if i != q)[:5]
        assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(want)]
    assert topk.top_k(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_simhash_against_brute_force(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(500)]
    texts = [None, "", "one", "One", "a b c"]
    for _ in range(25):
        base = [rng.choice(words) for _ in range(300)]
        texts += [" ".join(base)] * 2
        for _ in range(3):
            base = list(base)
            base[rng.randrange(300)] = "changed"
            texts.append("\t".join(base))
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    prints = [simhash.fingerprint(t) for t in texts]
    root = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 4:
            a, b = root[i], root[j]
            root = [min(a, b) if x in (a, b) else x for x in root]
    assert [got[i]["component_id"] for i in range(len(texts))] == root
    assert [got[i]["fingerprint"] for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    kept = {r["doc_id"] for r in simhash.one_of_each(docs(spark, texts)).collect()}
    assert {0, 2, 4} <= kept and len(kept) == 28
    assert simhash.near_duplicates(docs(spark, texts).limit(0)).count() == 0


def test_tiles_lose_no_link(spark):
    values = [0b1111 << (4 * i) for i in range(6)] + [0, 1 << 50, 3 << 50]
    table = spark.createDataFrame([(v, v.to_bytes(8, "big")) for v in values], "fp long, bits binary")
    found = simhash.stars(simhash.links(simhash.keyed_by_blocks(table, 4, 6), 4, tile=2)).collect()
    assert {r["node"] for r in found} == {v for v in values if v} and {r["root"] for r in found} == {0}


def test_language_and_quality(spark):
    rng = random.Random(4)
    speech = {"en": "the of and with this that from have", "de": "der die und mit das nicht von auch", "fr": "le les des avec dans que pour une", "es": "el los con para una que por como"}
    rows = [(i, " ".join(rng.choice(speech[k].split()) for _ in range(30)), k, "s", 1) for i in range(160) for k in [list(speech)[i % 4]]]
    table = spark.createDataFrame([*rows, (900, None, "en", "s", 0), (901, "12 !!", None, "s", 5)], SCHEMA)
    found = langid.predict(table, langid.fit(table, F.col("doc_id") % 5 != 2)).collect()
    assert all(r["lang_pred"] == r["lang"] for r in found if r["doc_id"] < 900)
    assert {r["lang_pred"] for r in found if r["doc_id"] >= 900} == {"und"}
    assert langid.predict(table, langid.fit(table.limit(0), F.lit(True))).filter("lang_pred != 'und'").count() == 0
    junk = spark.createDataFrame([(i, rows[i % 160][1] if i % 2 else "$$$ " * 40, i % 2) for i in range(200)] + [(900, None, 0)], "doc_id long, text string, label int")
    measured = quality.measure(junk)
    scored = {r["doc_id"]: r["score"] for r in quality.score(measured, quality.fit(measured.join(junk.select("doc_id", "label"), "doc_id"))).collect()}
    assert min(s for i, s in scored.items() if i % 2) > max(s for i, s in scored.items() if i % 2 == 0 and i < 900)
    assert {r["score"] for r in quality.score(measured, quality.fit(measured.join(junk.select("doc_id", "label"), "doc_id").limit(0))).collect()} == {0.5}


def test_secrets():
    tokens = secrets.encoder(open(secrets.VOCABULARY, "rb").read())
    text = 'é PassWord: "hunter22" AKIA' + "A1" * 8 + " x" + "0123456789abcdef" * 2 + " key zX9qLm2RtV8pWk4YbN7cHd3J and some_long_identifier_of_words_here1"
    n_assign, n_access, n_hex, _, spans = secrets.describe(text, tokens)
    assert (n_assign, n_access, n_hex) == (1, 1, 1) and spans.count("random") == 1
    assert secrets.describe(None, tokens)[:3] == (0, 0, 0)


def test_long_words_of_the_corpus_are_no_secrets(spark):
    rng = random.Random(7)
    syllables = "ein schl ber ken tung isch fahr lich ver ter gang mann".split()
    word = lambda n: "".join(rng.choice(syllables) for _ in range(n))
    texts = [" ".join(word(rng.randrange(1, 9)) for _ in range(60)) for _ in range(60)]
    planted = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(24)) for _ in range(20)]
    got = secrets.scan(docs(spark, texts + [f"key {p} end" for p in planted])).orderBy("doc_id").collect()
    assert not any("random" in r["spans"] for r in got[:60])
    assert sum("random:4:28" in r["spans"] for r in got[60:]) >= 18


def test_words_of_one_text_disclose_nothing(spark):
    texts = [f"unique{i} write to person{i}@mail.org about rare{i}" for i in range(20)] + ["agent falcon uses 0041 mail boss@corp.org", "the falcon again wrote boss@corp.org", "falcon: boss@corp.org", "in the park a falcon flew", *["common words in the park"] * 3]
    rows = {r["doc_id"]: r["spans"] for r in pii.report(docs(spark, texts)).collect()}
    assert all(rows[i].count(":") == 2 for i in range(20))
    assert "generalised:6:12" in rows[20] or "removed:6:12" in rows[20]
