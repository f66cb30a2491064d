"""The pipeline, stage by stage, against plain versions."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from stagehand.llm import langid, simhash
from stagehand.llm.common import MADE

from .test_brute import WORD, jaccard, plain_pii
from .test_operators import SCHEMA

SPEECH = {"en": "the of and with this that from have time year people way day thing", "de": "der die und mit das nicht von auch zeit jahr leute weg tag ding", "fr": "le les des avec dans que pour une temps monde jour chose gens", "es": "el los con para una que por como tiempo mundo cosa gente"}


def corpus(spark):
    rng = random.Random(17)
    say = lambda k, n: [rng.choice(SPEECH[k].split()) for _ in range(n)]
    rows = []
    for i in range(120):
        k = list(SPEECH)[i % 4]
        words = say(k, rng.randrange(30, 90))
        if i % 10 == 0:
            words.insert(5, f"mail person{i}@example.org near Marker{i}")
        rows.append([i, " ".join(words), k, f"src{i % 3}", 0])
    for i in range(20):  # copies and near copies
        words = rows[i][1].split()
        words[7 % len(words)] = "changed"
        rows.append([200 + i, rows[i][1] if i % 2 else " ".join(words), rows[i][2], "src9", 0])
    rows += [[300, None, "en", "s", 0], [301, "", None, None, 0], [302, "123 !!", "en", "s", 0], [303, "qzx vkj wpm " * 30, None, None, 0], [None, "the of and with this that from have year people " * 4, "en", None, 0]]
    rows += [list(rows[3]), list(rows[3])]  # repeated rows
    for r in rows:
        r[4] = len(r[1] or "")
    return spark.createDataFrame([tuple(r) for r in rows], SCHEMA)


def test_stages(spark, tmp_path):
    docs = corpus(spark)
    rows = docs.collect()
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
    model, classes = langid.fit(docs, train), langid.letter_classes()
    read = [(name, model.predict(r["text"], classes)) for name, r in enumerate(rows)]
    spoken = corpus_pipeline.language(spark, docs, "")
    kept = sorted(((r["doc_id"], r["text"]) for r in spoken.collect()), key=str)
    assert kept == sorted(((rows[n]["doc_id"], rows[n]["text"]) for n, (lang, score) in read if lang != "und" and score >= 0.5), key=str)
    assert {300, 301, 302}.isdisjoint(i for i, _ in kept) and len(kept) > 120 and spoken.columns == docs.columns

    one = corpus_pipeline.near_duplicates(spark, spoken, "")
    sets = [set(simhash.shingle_set(t, 5).tolist()) for _, t in kept]
    root = list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    least = {}
    for n, (i, _) in enumerate(kept):
        least.setdefault(root[n], []).append((i is None, i or 0))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in one.collect()) == sorted(min(x) for x in least.values())
    assert one.columns == docs.columns

    before = sorted(one.collect(), key=str)
    clean = {r["doc_id"]: r for r in corpus_pipeline.personal_data(spark, one, "").collect()}
    for r, (_, shown) in zip(before, plain_pii([r["text"] for r in before])):
        assert clean[r["doc_id"]]["text"] == shown and clean[r["doc_id"]]["n_chars"] == len(shown) and clean[r["doc_id"]]["source"] == r["source"]
    assert any("[EMAIL]" in r["text"] for r in clean.values())


def test_run(spark, tmp_path):
    docs = corpus(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    made = len(MADE)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(MADE) <= made + 2
    ids = [r["doc_id"] for r in got]
    assert len(ids) > 60 and {300, 301, 302, 303}.isdisjoint(ids) and max(ids.count(i) for i in set(ids)) <= 3
    for batch in {r["batch"] for r in got}:
        rows = [r for r in got if r["batch"] == batch]
        assert len({r["slot"] for r in rows}) == len(rows) and len(rows) * rows[0]["bucket_len"] <= 16384
    assert all(r["padding"] == r["bucket_len"] - r["n_tokens"] for r in got) and set(got[0].asDict()) >= {"doc_id", "lang", "source", "n_chars"}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "personal_data", "mixing", "packing"] and WORD
    docs.limit(0).write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
