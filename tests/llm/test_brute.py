"""The operators against plain versions, and the cases that each docstring defines."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from stagehand.llm import langid, media, mixing, packing, pii, quality, queries, secrets, simhash, topk

from .test_operators import SCHEMA, brute_pii, docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def key_of(seed, i, text):
    return int(hashlib.md5(f"{seed}|{'' if i is None else i}|{text or ''}".encode()).hexdigest()[:15], 16)


def folder(spark, tmp_path, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_packing_against_plain_version(spark):
    rng = random.Random(3)
    texts = [None, "", "x", "x", *(" ".join("w" * rng.randrange(1, 5) for _ in range(rng.choice((3, 9, 30, 31, 80, 200, 5000)))) for _ in range(70))]
    got = {(r["doc_id"]): r for r in packing.pack(docs(spark, texts).withColumn("batch", F.lit("clash")), buckets=3, budget=300).collect()}
    lengths = {i: len(WORD.findall(t or "")) for i, t in enumerate(texts)}
    every = sorted(set(lengths.values()))
    end = lambda x, ends: min(e for e in ends if e >= x)
    pad = lambda ends: sum(end(x, ends) - x for x in lengths.values())
    ends = {r["bucket_len"] for r in got.values()}
    assert pad(ends) == min(pad((*c, every[-1])) for c in itertools.combinations(every[:-1], 2))
    for n, e in enumerate(sorted(ends)):
        rows = sorted((i for i in lengths if end(lengths[i], ends) == e), key=lambda i: key_of("pack", i, texts[i]))
        holds = max(1, 300 // max(1, e))
        for place, i in enumerate(rows):
            r = got[i]
            assert (r["n_tokens"], r["bucket"], r["bucket_len"], r["batch"], r["slot"], r["padding"]) == (lengths[i], n, e, f"{n}-{place // holds}", place % holds, e - lengths[i])


def test_lengths_up_to_a_million_are_exact(spark):
    rows = spark.createDataFrame([(n,) for n in (0, 1, 4097, 9999, 1 << 20, (1 << 20) + 1, (1 << 22) + 3)], "n long").select("n", packing.bin_of(F.col("n")).alias("b")).collect()
    assert all(r["b"] == r["n"] for r in rows[:5]) and rows[6]["b"] <= rows[6]["n"] < rows[6]["b"] + 8


def plain_peaks(payload):
    """Peak pairs by loops over frames and bands."""
    window, x = np.hanning(512), np.frombuffer(payload, np.uint8) / 128 - 1
    frames = max(1, math.ceil((len(x) - 512) / 256) + 1)
    at, high = [], []
    for f in range(frames):
        part = np.zeros(512)
        part[: len(x[f * 256 : f * 256 + 512])] = x[f * 256 : f * 256 + 512]
        level = np.rint(80 * np.log10(np.abs(np.fft.rfft(part * window)) + 1e-6)).astype(int)
        bands = [(a, level[a:b]) for a, b in zip(media.BANDS, media.BANDS[1:])]
        at.append([a + int(v.argmax()) for a, v in bands])
        high.append([int(v.max()) for _, v in bands])
    peaks = [(f, at[f][k]) for f in range(frames) for k in range(4) if (f == 0 or high[f][k] > high[f - 1][k]) and (f == frames - 1 or high[f][k] >= high[f + 1][k])]
    pairs = [(t, a << 14 | b << 5 | u - t) for n, (t, a) in enumerate(peaks) for u, b in peaks[n + 1 : n + 3] if u - t <= 16]
    return " ".join(f"{t:x}:{h:x}" for t, h in sorted(pairs))


def test_media_features_against_plain_version(spark):
    rng = random.Random(2)
    texts = [None, "", "a", "é" * 40, *("".join(rng.choice("abcdefgh \n") for _ in range(rng.randrange(10, 6000))) for _ in range(12)), "long text " * 60000]
    table = docs(spark, texts).withColumns({"feature": F.lit("clash"), "_text": F.lit("clash")})
    for r in media.media(table).collect():
        data = (texts[r["doc_id"]] or "").encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(data), len(payload), zlib.crc32(payload[-64:]))
        assert r["feature"] == plain_peaks(payload)
    assert media.media(table.limit(0)).count() == 0


def test_quality_query(spark, tmp_path):
    rng = random.Random(4)
    words = "time year people way day man thing woman life child world school state family student group country problem hand part".split()
    good = lambda: ". ".join(" ".join(rng.choice(words) for _ in range(9)).capitalize() for _ in range(8)) + "."
    bad = lambda: "!!! BUY $$$ " * rng.randrange(5, 30) + rng.choice(words)
    texts = [good() if i % 2 else bad() for i in range(240)] + [None, "", "very long text. " * 80000]
    table = docs(spark, texts).unionByName(spark.createDataFrame([(None, "no id", None, None, None)], SCHEMA))
    labels = spark.createDataFrame([*((i, i % 2, 0) for i in range(240)), (240, None, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in queries.op3_quality(spark, folder(spark, tmp_path, documents=table, labels=labels)).collect()}
    assert len(got) == 244 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    for i in range(240):
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
    held = [i for i in range(240) if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == i % 2 for i in held) >= 0.9 * len(held) and not got[None]["held_out"]
    assert got[240]["score"] == got[241]["score"]
    clash = quality.measure(table.withColumns({"stats": F.lit(1), "score": F.lit("x")}))
    assert clash.columns == ["doc_id", "stats"] and quality.measure(table.limit(0)).count() == 0
    total, ones = np.array([4.0, 4, 0, 4, 4]), np.array([0.0, 3, 0, 1, 4])
    assert quality.isotonic(total, ones).tolist() == [0, 0.5, 0.5, 0.5, 1]


def test_language_query(spark, tmp_path):
    rng = random.Random(4)
    speech = {"en": "the of and with this that from have", "de": "der die und mit das nicht von auch", "fr": "le les des avec dans que pour une", "es": "el los con para una que por como"}
    rows = [(i, " ".join(rng.choice(speech[k].split()) for _ in range(25)), k, "s", 1) for i in range(200) for k in [list(speech)[i % 4]]]
    odd = [(500, None, "en", "s", 0), (501, "", None, "s", 0), (502, "12 !! \U0001F600", "de", "s", 0), (503, "the of and with " * 60000, None, "s", 0), (504, "\U0001F600 \U0001F600", None, None, 0), (None, "le les des avec dans", None, None, 0)]
    table = spark.createDataFrame([*rows, *odd], SCHEMA)
    got = {r["doc_id"]: r for r in queries.op6_langid(spark, folder(spark, tmp_path, documents=table)).collect()}
    assert len(got) == 206 and all(0 <= r["score"] <= 1 for r in got.values())
    for i, _, k, *_ in rows:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and got[i]["lang_pred"] == k
    assert [got[i]["lang_pred"] for i in (500, 501, 502, 503, 504, None)] == ["und", "und", "und", "en", "und", "fr"]
    # The machines by their definition: the loss of each at its weights is no larger than nearby.
    model = langid.fit(table, F.lit(True))
    for text in (rows[0][1], rows[1][1], "le la un"):
        x = langid.features(text, langid.letter_classes())
        votes = {n: 0 for n in model.families[0]}
        for i, j, w, b in model.families[1]:
            votes[model.families[0][i if x @ w + b >= 0 else j]] += 1
        assert langid.family(model.predict(text, langid.letter_classes())[0]) == max(votes, key=votes.get)
    clash = langid.predict(table.withColumns({"score": F.lit("x"), "lang_pred": F.lit("y")}), model)
    assert clash.columns.count("score") == 1 and langid.predict(table.limit(0), model).count() == 0


def plain_pii(texts, window=8, remove=0.5, generalise=1.0):
    """(doc, spans, masked text) by loops: base spans, then terms by co-occurrence over distinct texts."""
    runs = lambda t: [(m.start(), m.end(), m.group().lower()) for m in regex.finditer(r"[\p{L}\p{N}]+", t)]
    clash = lambda a, b, spans: any(s < b and a < e for s, _, e in spans)
    distinct = {t for t in texts if t}
    base = {t: brute_pii(t) for t in distinct}
    holds = {t: {w for _, _, w in runs(t)} for t in distinct}
    near = {}
    for t in distinct:
        for s, k, e in base[t]:
            sides = [r for r in runs(t) if r[1] <= s][-window:] + [r for r in runs(t) if r[0] >= e][:window]
            near.setdefault((k, t[s:e].lower()), {}).setdefault(t, set()).update(w for a, b, w in sides if not clash(a, b, base[t]))
    bits = lambda n, both: math.log2((n + 1) / both)
    flagged = {}
    for e, by in near.items():
        for w in set().union(*by.values()):
            left = bits(sum(w in holds[t] for t in distinct), sum(w in x for x in by.values()))
            if left <= max(remove, generalise) and sum(w in x for x in by.values()) >= 2:
                flagged.setdefault(w, []).append((left, e))
    instead = {}
    for w, found in flagged.items():
        instead[w] = ""
        if min(found)[0] > remove:
            for level in pii.LEVELS:
                if len(w) > level and instead[w] == "":
                    part = w[:level]
                    around = {t for by in near.values() for t, ws in by.items() if any(x[:level] == part for x in ws)}
                    if all(bits(len(around), sum(any(x[:level] == part for x in ws) for ws in near[e].values())) > generalise for _, e in found):
                        instead[w] = f"[{part}*]"
    out = []
    for t in texts:
        text = t or ""
        spans = [(s, k, e, pii.MASK[pii.KINDS[k]]) for s, k, e in base.get(text, [])]
        spans += [(a, 5 if instead[w] else 4, b, instead[w]) for a, b, w in runs(text) if w in instead and not clash(a, b, base.get(text, []))]
        spans.sort()
        at, shown = 0, ""
        for s, _, e, mask in spans:
            if s >= at:
                shown += text[at:s] + mask
            at = max(at, e)
        out.append((",".join(f"{(*pii.KINDS, *pii.EXTRA)[k]}:{s}:{e}" for s, k, e, _ in spans), None if t is None else shown + text[at:]))
    return out


def test_pii_against_plain_version(spark):
    rng = random.Random(12)
    common = [f"word{i}" for i in range(30)]
    rare = lambda: rng.choice(("zim", "bra", "")) + "".join(rng.choice("bcdfgklmz") for _ in range(rng.choice((1, 3, 7))))
    people = [("ann@a.org", "Zanzibarov"), ("+1 (234) 555-7890", "Quillfeather"), ("10.0.0.7", "Émilie"), ("4111111111111111", "x")]
    texts = [None, "", " ", "é" * 10 + "a@b.cc" + "9" * 4, "nothing here", "averyveryverylongwordthatpassesthewindow " * 12 + "bob@b.org"]
    for n in range(90):
        body = [rng.choice(common) for _ in range(rng.randrange(4, 40))]
        if n % 3 == 0:
            who, name = rng.choice(people)
            body.insert(rng.randrange(len(body)), rng.choice([f"{name} {who}", f"{who} the {name}", f"{name.upper()}, {who}", f"x{who}"]))
        if n % 2 == 0:
            body.insert(rng.randrange(len(body)), rare())
        if n % 11 == 0:
            body.append(rng.choice(people)[1])
        texts.append(rng.choice([" ", ", ", "\n"]).join(body))
    texts += ["call zimquill at q@q.org", "zimquill wrote q@q.org twice", "zimother r@r.org", "zimthird s@s.org", "zimfourth t@t.org"]
    texts += texts[6:20]
    table = docs(spark, texts).withColumns({"digest": F.lit("clash"), "spans": F.lit("clash"), "base": F.lit(1)})
    want = plain_pii(texts)
    got = {r["doc_id"]: r for r in pii.report(table).collect()}
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(table).collect()}
    assert len(got) == len(clean) == len(texts)
    for i, (spans, shown) in enumerate(want):
        assert got[i]["spans"] == spans, (texts[i], got[i]["spans"], spans)
        assert clean[i] == shown
    kinds = ",".join(s for s, _ in want)
    assert "generalised" in kinds and "removed" in kinds
    assert pii.sanitise(table).columns == table.columns and pii.sanitise(table.limit(0)).count() == 0
    nameless = spark.createDataFrame([(None, "mail c@d.ee now")] * 2, "doc_id long, text string")
    assert [r["n_email"] for r in pii.report(nameless).collect()] == [1, 1]


def test_topk_beyond_a_long_and_hot_cells(spark):
    rows = [(0, [1e300, 1.0]), (1, [-1e300, 2.0]), (2, [1e300, 1e300]), (3, [5e15, 1.0]), (4, [0.0, 0.0]), (5, []), (100, [1e300, -1e300]), (101, [float("inf"), 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit("x"), "v": F.lit(1), "pivot": F.lit(2)})
    floor = lambda x: max(-(1 << 63), min((1 << 63) - 1, math.floor(x * 1024)))
    good = {i: [floor(x) for x in (*v, *[0.0] * (2 - len(v)))] for i, v in rows if i != 101}
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(table, F.col("vec_id") % 100 == 0, k=3).collect()}
    score = lambda q, x: max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(q, x))))
    for q in (0, 100):
        best = sorted((-score(good[q], v), i) for i, v in good.items() if i != q)[:3]
        assert [got[q, n + 1] for n in range(3)] == [(i, -s) for s, i in best]
    rng = np.random.default_rng(5)
    hot = [(i, [float(x) for x in rng.normal(3, 0.01, size=4)]) for i in range(500)]  # one cell holds nearly all
    table = spark.createDataFrame([*hot, *hot[:3]], "vec_id long, embedding array<double>")
    good = [(i, np.floor(1024 * np.array(v)).astype(int)) for i, v in [*hot, *hot[:3]]]
    found = {}
    for r in topk.top_k(table, F.col("vec_id") % 100 == 0, k=10, pivots=3, rings=2, pack=16, first=20).collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    for q, v in hot[::100]:
        mine = np.floor(1024 * np.array(v)).astype(int)
        best = sorted((-int(mine @ x), i) for i, x in good if i != q)[:10]
        assert sorted(found[q], key=lambda x: (-x[1], x[0])) == [(i, -s) for s, i in best]


def test_simhash_hot_shards_and_cases(spark):
    rng = random.Random(7)
    base = rng.getrandbits(64)
    values = {base} | {base ^ (1 << a) ^ (1 << b) for a in range(0, 40, 3) for b in range(1, 41, 4)} | {rng.getrandbits(64) for _ in range(200)} | {0b11111 << 5 * k for k in range(6)}
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    table = spark.createDataFrame([(v,) for v in signed], "fp long")
    for tile in (8, 1024):
        rooted = {r["node"]: r["root"] for r in simhash.stars(simhash.links(simhash.keyed_by_blocks(table, 4, 6), 4, tile=tile)).collect()}
        root = {v: v for v in signed}
        for a, b in itertools.combinations(signed, 2):
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4 and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {k: low if x == high else x for k, x in root.items()}
        assert {v: rooted.get(v, v) for v in signed} == root
    assert [simhash.blocks_for(n) for n in (0, 1 << 27, (1 << 27) + 1, 1 << 34)] == [6, 6, 7, 8]
    rows = spark.createDataFrame([(None, "a b c d e"), (7, "a b c d e"), (None, "x y z u v w"), (3, None), (5, ""), (8, "long words here " * 80000)], "doc_id long, text string")
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(rows.withColumns({"fp": F.lit("x"), "bits": F.lit("y"), "component_id": F.lit(0)})).collect()]
    assert sorted(c for i, f, c in got if f == f"{simhash.fingerprint('a b c d e'):016x}") == [7, 7]
    assert (None, f"{simhash.fingerprint('x y z u v w'):016x}", None) in got and {c for i, f, c in got if i in (3, 5)} == {3} and len(got) == 6


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("tile", [12, 1024])
def test_similar_classes_against_plain_version(spark, tile):
    rng = random.Random(21)
    draw = lambda n: [f"w{rng.randrange(10**5)}" for _ in range(n)]
    texts = [None, "", "  ", "one two", "One  two", "one three"]
    for changed in (2, 5, 8, 10, 11, 12, 14, 30):  # similarities from 0.98 to about 0.65
        for _ in range(5):
            words = draw(rng.choice((120, 300)))
            at = [rng.randrange(len(words)) for _ in range(changed * len(words) // 300)]
            texts += [" ".join(words), " ".join("new" + w if i in at else w for i, w in enumerate(words))]
    words = draw(150)
    texts += [" ".join(words if k % 9 == 0 else [w if rng.random() > 0.012 else f"e{rng.random()}" for w in words]) for k in range(60)]  # a group of near copies
    rng.shuffle(texts)
    sets = [set(simhash.shingle_set(t, 5).tolist()) for t in texts]
    root = list(range(len(texts)))
    near = 0
    for i, j in itertools.combinations(range(len(texts)), 2):
        if jaccard(sets[i], sets[j]) >= 0.8:
            near += 1
            low, high = sorted((root[i], root[j]))
            root = [low if x == high else x for x in root]
    kept = sorted(r["doc_id"] for r in simhash.one_of_each(docs(spark, texts).withColumns({"fp": F.lit(1), "root": F.lit(2), "label": F.lit(3)}), tile=tile).collect())
    assert near > 300 and kept == sorted(set(root))


def test_one_row_of_each_class_stays(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = spark.createDataFrame([(5, a, "s"), (5, b, "s"), (6, "c d e", "s"), (6, "c d e", "t"), (None, "f g h", "u"), (None, "f g h", "u"), (None, a, "v")], "doc_id long, text string, source string")
    got = sorted((r["doc_id"] or 0, r["text"]) for r in simhash.one_of_each(rows).collect())
    assert got == sorted([(5, a), (5, b), (6, "c d e"), (0, "f g h")]) and simhash.one_of_each(rows.limit(0)).count() == 0


def test_mixing_ties_and_repeats(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (2, "", "x"), (3, None, None), (4, "d " * 30, "y"), (5, "e", "z"), (6, "f", "z"), (7, " \t", "w")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"target": F.lit("clash"), "taken": F.lit("clash")})
    got = [r.asDict() for r in mixing.mix(table).collect()]
    assert len(got) == 8 and all(r["size"] == len(WORD.findall(dict((i, t) for i, t, _ in rows)[r["doc_id"]] or "")) for r in got)
    twins = [r["taken"] for r in got if r["doc_id"] == 1]
    assert twins[0] == twins[1] and all(r["taken"] <= 3 * r["size"] for r in got) and sum(r["taken"] for r in got) <= sum(r["size"] for r in got)
    assert all(r["target"] <= 3 * r["source_size"] + 1e-9 for r in got) and {r["doc_id"]: r["target"] for r in got}[7] == 0
    assert [r["taken"] for r in mixing.mix(table).orderBy("doc_id").collect()] == [r["taken"] for r in mixing.mix(table.repartition(3)).orderBy("doc_id").collect()]


def plain_secrets(text, tokens):
    """Base and random spans without any shortcut."""
    text = text or ""
    base = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m.group(2)) >= 6]
    base += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    base += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 24]
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]+", text):
        run, low = m.group(), secrets.RATIO - 3.2 / len(m.group())
        cut_off = run.isalpha() and (text[m.start() - 1 : m.start()].isalpha() or text[m.end() : m.end() + 1].isalpha())
        known = secrets.DIGEST.fullmatch(run) or secrets.UUID.fullmatch(run)
        if len(run) >= 16 and re.search("[A-Za-z]", run) and not cut_off and not known and not any(s < m.end() and m.start() < e for s, _, e in base):
            if not secrets.is_identifier(run, tokens, low) and len(run) / tokens(run) <= low:
                out.append((m.start(), 3, m.end()))
    return sorted(base), sorted(base + out)


def test_secrets_against_plain_version(spark):
    tokens = secrets.encoder(open(secrets.VOCABULARY, "rb").read())
    rng = random.Random(31)
    alpha = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    bits = ["password=", "token: '", "API_KEY = ", "AKIA" + "Z9" * 9, "é", " ", "\n", "deadbeef" * 4, "sha256-" + "Ab0+" * 11, "my-blog-post-about-weather", "getUserAccountByName", "internationalization", "-" * 20, "1234567890123456", "123e4567-e89b-12d3-a456-426614174000"]
    texts = [None, "", "slug" + "-ab" * 200 + "-12345", "x" * 200000, " ".join("".join(rng.choice(alpha) for _ in range(24)) for _ in range(2000))]
    texts += ["".join(rng.choice([*bits, "".join(rng.choice(alpha) for _ in range(rng.randrange(4, 40)))]) for _ in range(rng.randrange(1, 16))) for _ in range(150)]
    table = docs(spark, texts).withColumns({"spans": F.lit("clash"), "n_hex": F.lit("clash"), "_text": F.lit("clash")})
    names = (*secrets.KINDS, "random")
    show = lambda spans: ",".join(f"{names[k]}:{s}:{e}" for s, k, e in spans)
    got = {r["doc_id"]: r for r in secrets.scan(table).collect()}
    for i, t in enumerate(texts):
        base, every = plain_secrets(t, tokens)
        r = got[i]
        assert r["spans"] == show(every), t[:200] if t else t
        assert r["base_sha256"] == hashlib.sha256(show(base).encode()).hexdigest() and (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == n for _, k, _ in base) for n in range(3))
    assert got[2]["spans"] == "" and got[4]["spans"].count("random") > 1990 and secrets.scan(table.limit(0)).count() == 0
    spark.conf.set("spark.stagehand.vocabulary", "/no/such/file")
    try:
        with pytest.raises(FileNotFoundError):
            secrets.scan(table)
    finally:
        spark.conf.unset("spark.stagehand.vocabulary")


def test_candidates_grow_with_the_input(spark):
    rng = random.Random(6)
    passage = " ".join(f"p{i}" for i in range(40))

    def proposed(n):
        texts = [passage + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(160)) for _ in range(n)]
        texts += [t.replace(" w", " v", 1) for t in texts[: n // 4]]
        marked = simhash.measured(docs(spark, texts), "text", 5, 0.8, len(texts))
        keyed = marked.select(F.col("_nd_fp").alias("fp"), F.col("_nd_bits").alias("bits"), F.posexplode("_nd_keys").alias("mask", "key"))
        return simhash.searched(simhash.first_round(keyed, *simhash.hot_shards(keyed, 1024)), 60, True).select("a", "b").distinct().count()

    few, many = proposed(200), proposed(400)
    assert 50 <= few <= 60 and 100 <= many <= 2.1 * few
    shapes = [simhash.bands_for(n, 0.8) for n in (10, 10**6, 10**8, 10**10)]
    assert shapes == sorted(shapes) and all((1 - 0.8**wide) ** bands <= 1e-4 for bands, wide in shapes)


@pytest.mark.parametrize("chunk", [1, 2, 3, 50])
def test_language_features_do_not_depend_on_pieces(monkeypatch, chunk):
    rng = random.Random(4)
    texts = ["", "a", "12", "ΑΣ ß İx" * 9, *("".join(rng.choice("abcdeéñßж 12İΣ\n") for _ in range(rng.randrange(1, 300))) for _ in range(60))]
    whole = [langid.features(t, langid.letter_classes()) for t in texts]
    monkeypatch.setattr(langid, "CHUNK", chunk)
    for t, x in zip(texts, whole):
        got = langid.features(t, langid.letter_classes())
        assert (got is None) == (x is None) and (x is None or np.array_equal(got, x))


def test_topk_leaves_most_clustered_vectors_unread(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(200, 64))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    vectors = centres[rng.integers(0, 200, 40_000)] + rng.normal(scale=0.02, size=(40_000, 64))
    table = spark.createDataFrame(((i, v.tolist()) for i, v in enumerate(vectors)), "vec_id long, embedding array<double>").repartition(8)
    read = spark.sparkContext.accumulator(0)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(table, F.col("vec_id") % 1000 == 0, read=read).collect()}
    whole = np.floor(1024 * vectors).astype(np.int64)
    for q in range(0, 40_000, 1000):
        s = whole @ whole[q]
        best = [i for i in np.lexsort((np.arange(40_000), -s))[:11] if i != q][:10]
        assert [got[q, n + 1] for n in range(10)] == [(i, s[i]) for i in best]
    assert read.value <= 0.3 * 40 * 40_000
