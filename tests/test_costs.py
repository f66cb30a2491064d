"""Steps whose cost must not grow faster than their input."""

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from stagehand.functions import markup, text
from stagehand.sources import details


def _flat(node):
    return node.tag, node.attrs, [x if isinstance(x, str) else _flat(x) for x in node.inside]


def _parsed(page):
    reader = markup._Reader()
    reader.feed(page)
    reader.close()
    return _flat(reader.root)


PARTS = ["<div>", "</div>", '<p class="a b">', "</p>", "<br/>", "<br>", "text &amp; more", "a < b", "<script>", "x<y", "</script>", "<title>", "</title>", "<a href='x?a=1&amp;b' id=q>", "</a>", "<style>p{}</style>", "&copy", "&",
         "<!-- c -->", '<input disabled value="">', "<IMG SRC=x>", "</b >", '<script type="application/ld+json">{"a": "&amp;"}</script>', "<textarea>", "</textarea>", "\n", "<li/>", "<", ">", '"', "<x-y>", "<a b=c/>", '<a href="x"b="y">', "<a x='1' x='2'>", "&#39;", "<!DOCTYPE html>", "</P>"]


def test_plain_pages_are_read_as_the_parser_reads_them(monkeypatch):
    rng, plain = random.Random(1), 0
    for _ in range(20_000):
        page = "".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 7)))
        plain += markup._plain(page) is not None
        assert _flat(markup.tree(page)) == _parsed(page), page
    assert plain > 5_000
    monkeypatch.setattr(markup, "_Reader", None)
    root = markup.tree("<!doctype html><div class='card big'><h3>A &amp; B</h3><br><a href=\"/s/1\">more</a></div>")
    assert [n.text() for n in markup.select(root, "div.card.big > h3, a[href]")] == ["A & B", "more"] and markup.first(root, "em") is None
    assert markup.compiled("div.card") is markup.compiled("div.card")


def test_paragraphs_are_cut_once(spark):
    rows = spark.createDataFrame([("x" * 60 + "\n" + "x" * 60 + "\nshort\n" + "y" * 60,)], "t string").select(text.paragraphs(F.col("t")).alias("ps"))
    assert rows.first()["ps"] == ["x" * 60, "y" * 60]
    assert len(re.findall(r"split\(", rows._jdf.queryExecution().optimizedPlan().toString())) == 1


def test_booking_phrases_are_found_by_one_automaton(spark):
    said = ["BOOK NOW", "the cook", None, "", "50% off", "call 020", "[email protected]", "Members offer", "e-tickets", "under 18 are not permitted", "£5", "A plain line of copy", "check back for returns", "★ four", "SHOUT", "He presents:"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, t string")
    got = text.with_chrome(rows, "t", "quick").select("t", "quick", text.is_chrome(F.col("t")).alias("plain"), text.chrome_phrases(F.col("t")).alias("phrases"))
    for r in got.collect():
        want = [p for p in text.CHROME if re.search(f"(?i){p}", r["t"] or "")]
        assert r["phrases"] == want and r["quick"] == r["plain"], r["t"]
        assert r["quick"] == (bool(want) or r["t"] in (None, "", "★ four", "SHOUT", "He presents:")), r["t"]
    assert "names_chrome" in rows.select(text.chrome_phrases(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()


SAID = ["one text", " padded \n", "\n", "a > b", " > ", "R&amp;D", "&#xfdd0;0&#xfdd1;", "synopsis", "The  Story", "100 % s %s", "x content='bar' y", "R&D content='bar' ", "a < b", "<", "\ufdd00\ufdd1", "\ufdd2", "it's \"quoted\"", "&", "\x1c", "&nbsp;"]
TAGS = ["<div>", "</div>", "<p class=d>", "<p>", "</p>", "<h1>", "</h1>", "<h2>", "</h2>", "<article>", "</article>", "<em>", "</em>", "<font>", "</font>", "<script>", "</script>", "<title>", "</title>", "<meta property='og:title' content='A | B'>", '<meta name="description" content="It\'s %s">',
        "<meta content=' padded ' name=description>", "<time datetime='2026-10-01T19:00'>", '<time class="d" datetime=" 2026-10-02">', "</time>", "<a title='x > y'>", "<a content='v' class='d'>", "</a>", "<!-- c > d -->", "<!DOCTYPE html>", "<textarea>"]


def test_pages_of_a_template_are_read_as_their_trees_are(monkeypatch):
    rng, by_template, known = random.Random(5), 0, {}
    for _ in range(5_000):
        made = "".join(rng.choice(TAGS if rng.random() < 0.55 else SAID) for _ in range(rng.randrange(1, 14)))
        for selector in (".d", None, "[content]", "p:first-of-type"):
            assert details._read(made, selector, known, 16) == details._parts(markup.tree(made), selector), made
        outline = markup.outline(made)
        by_template += bool(outline and outline[1] and details._template(outline[0], None))
    assert by_template > 500
    page = "<meta property='og:title' content='Show {0}'><h1>No. {0}</h1><article><p>Copy %s of {0}</p></article><div class=d><time datetime='2026-10-{0:02d}T19:00'>x</time></div>"
    assert details._read(page.format(1), ".d", known)[1] == "No. 1"
    monkeypatch.setattr(markup, "tree", None)
    monkeypatch.setattr(markup, "_plain", None)
    got = [details._read(page.format(i), ".d", known) for i in range(10, 30)]
    assert [(g[0], g[1], g[5], g[6][0][0]) for g in got] == [(f"Show {i}", f"No. {i}", [f"2026-10-{i}T19:00"], f"Copy %s of {i}") for i in range(10, 30)]


def test_facts_of_pages_are_found_within_their_rows(spark):
    rows = spark.createDataFrame([("t", "<p>x</p>")], "title string, body string")
    plan = details.facts_of(rows, F.current_date())._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("Join|UnionLoop|Aggregate", plan) and plan.count("page_parts") == 1


def test_suspects_hold_all_chrome_and_credits(spark):
    said = ["Book now", "the cook", "From 4 May it is on", "Some Company presents a night", "He presents:", "\u2605 four", "'quoted'", "A night. \u201cSplendid\u201d - The Paper", "By Ann Other.", "Written and directed by Bo", "Music by: Cy", "A plain line of copy that says nothing of the sort", "a \u2605\u2605 b", "Book  now", "\u00a0 Book\u2003now", "One.Two!Three", "A.\u201cB\u201d", "e\u0301Presents x", " \x85x\u2028y\x1cz "]
    batch = text.cleaned(pa.array(said))
    rows = spark.createDataFrame([(s, c, m) for s, c, m in zip(said, batch.to_pylist(), text.suspect(batch).to_pylist(), strict=True)], "s string, c string, m boolean")
    got = rows.select("s", "c", "m", text.clean_spaces(F.col("s")).alias("clean"), ((text.is_chrome(F.col("c")) & ~text.is_shouted(F.col("c"))) | text.is_credits(F.col("c")) | F.col("c").rlike(text.PRESENTS)).alias("bad")).collect()
    assert all(r["c"] == r["clean"] and (r["m"] or not r["bad"]) for r in got), got
    assert sum(r["bad"] for r in got) > 10 and not got[11]["m"]
