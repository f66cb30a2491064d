"""Cases in which an operator did less than its whole job."""

import random

from pyspark.sql import functions as F

from stagehand.llm import langid, pii, secrets, simhash

from .test_operators import docs


def test_disclosing_terms_go_everywhere(spark):
    far = " ".join(["filler"] * 60)
    texts = [f"note {i} from Zanzibarov at z@y.org about things {far} ZANZIBAROV again" for i in range(4)]
    texts += ["a fifth text names Zanzibarov alone", *(f"note {i} about things from others at {far}" for i in range(40)), None, ""]
    table = docs(spark, texts)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(table).collect()}
    assert clean[0] == f"note 0 from  at [EMAIL] about things {far}  again"
    assert clean[4] == "a fifth text names  alone"
    assert all(clean[i] == texts[i] for i in range(5, len(texts)))
    spans = {r["doc_id"]: r["spans"] for r in pii.report(table).collect()}
    assert spans[4] == "removed:19:29" and spans[5] == spans[45] == ""


def test_near_duplicates_are_verified(spark):
    rng = random.Random(13)
    draw = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts, want = [], 0
    for changed in (43, 28):  # similarities near 0.75 and 0.83
        for _ in range(30):
            base = draw(300)
            texts += [" ".join(base), " ".join(base[changed:] + draw(changed))]
            want += 2 if changed == 43 else 1
    passage = " ".join(draw(20))
    for _ in range(2):
        texts.append(" ".join([passage] * 40 + draw(200)))
    sole = " ".join(draw(40))
    texts += [sole, f"{sole} {sole}"]
    want += 2 + 1
    kept = {r["doc_id"] for r in simhash.one_of_each(docs(spark, texts)).collect()}
    sets = [set(simhash.shingle_set(t, 5).tolist()) for t in texts]
    assert all((i + 1 in kept) == (len(sets[i] & sets[i + 1]) < 0.8 * len(sets[i] | sets[i + 1])) for i in range(0, len(texts), 2))
    assert len(kept) == want


def test_unlearned_languages_are_rejected(spark):
    rng = random.Random(4)
    speech = {"en": "the of and with this that from have", "de": "der die und mit das nicht von auch", "fr": "le les des avec dans que pour une", "es": "el los con para una que por como"}
    texts = [" ".join(rng.choice(speech[k].split()) for _ in range(30)) for _ in range(40) for k in speech]
    table = docs(spark, texts).withColumn("lang", F.element_at(F.array(*map(F.lit, speech)), (F.col("doc_id") % 4 + 1).cast("int")))
    junk = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(60)) for _ in range(10)]
    found = langid.accepted(docs(spark, [*texts[:40], *junk, "\U0001F600 \U0001F44D"]), langid.fit(table, F.lit(True)))
    assert {r["doc_id"] for r in found.collect()} == set(range(40))


def test_only_letters_have_a_class():
    classes = langid.letter_classes()
    assert langid.features("\U0001F600 \U0001F44D 12", classes) is None
    assert langid.features("\U00010400\U00020000", classes) is not None


def test_short_and_letters_only_secrets():
    tokens = secrets.encoder(open(secrets.VOCABULARY, "rb").read())
    found = lambda t: secrets.describe(t, tokens)[4]
    for secret in ("zX9qLm2RtV8pWk4Y", "qzxvkjwpmtrbnhgfdsqz12", "qzxvkjwpmtrbnhgfdsqz", "XqZvKjWpMtRbNhGfDs"):
        assert found(f"key {secret} end") == f"random:4:{4 + len(secret)}", secret
    assert found("some_long_identifier_of_words_here1 internationalization getUserAccountByName2 1234567890123456 ----------------") == ""
