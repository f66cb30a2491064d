"""HTML extraction: containers, alignment, neighbours, ranges, and a brute-force version of the whole."""

import random

import pytest
from pyspark.sql import functions as F

from stagehand.llm import html_extract

PAGES = "page_id long, url string, html string"


def texts(spark, rows, **options):
    table = spark.createDataFrame(rows, PAGES).repartition(3)
    return {r["page_id"]: r["text"] for r in html_extract.extract(table, **options).collect()}


def main_lines(page):
    return [x.text for x in html_extract.lines(page) if x.main]


def test_containers():
    frame = "<html><head><title>t</title><script>var x='</p>';</script></head><body><nav><a>Menu</a></nav><div class='ad'>Buy</div>"
    page = frame + "<article><h1>A &amp; B</h1><p><b>One\n two<br>three<p>Four</p><div id='comments'>nice</div></article><footer>f"
    assert main_lines(page) == ["A & B", "One two three", "Four"]
    assert [x.text for x in html_extract.lines(page)] == ["t", "Menu", "Buy", "A & B", "One two three", "Four", "nice", "f"]
    assert html_extract.lines(None) == [] and main_lines("<p>open <div>x</i></p>y") == ["open", "x", "y"]


def test_small_cases(spark):
    free = [(i, f"http://h/{i}", f"<body><div>Site name</div><p>Own {i}</p><div>End</div>") for i in range(3)]
    article = "<article><h1>A</h1><p>One</p></article>"
    got = texts(spark, [*free, (7, None, None), (8, "http://other/", article), (9, "", ""), (None, "http://n/", "<p>No id</p>")])
    assert got == {0: "Own 0", 1: "Own 1", 2: "Own 2", 7: "", 8: "A\nOne", 9: "", None: "No id"}
    table = spark.createDataFrame(free, PAGES)
    assert html_extract.extract(table.limit(0)).count() == 0
    clash = table.withColumns({"text": F.lit("x"), "n_chars": F.lit("y"), "_host": F.lit("z")})
    rows = html_extract.extract(clash).collect()
    assert {(r["page_id"], r["text"], r["n_chars"]) for r in rows} == {(i, f"Own {i}", 5) for i in range(3)}
    assert [r["text"] for r in html_extract.extract(table.filter("page_id = 1").union(table.filter("page_id = 1"))).collect()] == ["Site name\nOwn 1\nEnd"] * 2


def test_frame_lines_inside_articles_go(spark):
    page = "<article><div>Read this next</div><h1>Title {0}</h1><p>Own {0}</p><p>{1}</p><ul><li>Print</li></ul><p>Everywhere</p></article>"
    got = texts(spark, [(i, f"http://h/{i}", page.format(i, "Quoted by some" if i % 3 else f"Else {i}")) for i in range(9)])
    for i in range(9):
        assert got[i] == f"Title {i}\nOwn {i}\n" + ("Quoted by some" if i % 3 else f"Else {i}")


def test_copies_keep_their_text(spark):
    own = "".join(f"<p>Passage {i} of the main text</p>" for i in range(30))
    body = "<body><div>Site name</div>{}<div>End</div>"
    free = [(i, "http://h/a", body.format(own)) for i in range(3)] + [(3, "http://h/a", body.format(own + "<p>Added</p>")), (4, "http://h/b", body.format("<p>Other</p>"))]
    got = texts(spark, [*free, *((i, "http://g/a", body.format(own)) for i in (5, 6))])
    main = "\n".join(f"Passage {i} of the main text" for i in range(30))
    assert [got[i] for i in range(5)] == [main, main, main, f"{main}\nAdded", "Other"]
    assert main in got[5] and main in got[6]


def brute(rows, edge):
    """Every page against its neighbours in the whole host, without ranges."""
    hosts = {}
    for i, url, html in rows:
        path, _, query = url.removeprefix("http://").partition("/")[2].partition("?")
        hosts.setdefault(url.split("/")[2], []).append((path, query, i, html_extract.Page(html)))
    out = {}
    for pages in hosts.values():
        pages.sort(key=lambda p: p[:3])
        for at, (_, _, i, page) in enumerate(pages):
            near = []
            for step in range(1, edge + 1):
                for j in (at - step, at + step):
                    if 0 <= j < len(pages) and len(near) < html_extract.NEIGHBOURS and not any(pages[j][3].alike(x) for x in (page, *near)):
                        near.append(pages[j][3])
            kept = []
            for n, line in enumerate(page.lines):
                times = sum(n in longest(page.texts, x.texts) for x in near)
                if line.main and times < line.need:
                    kept.append(line.text)
            out[i] = "\n".join(kept)
    return out


def longest(a, b):
    """Places in ``a`` of a longest common subsequence by the usual table; unique where lines are."""
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            table[i][j] = table[i + 1][j + 1] + 1 if a[i] == b[j] else max(table[i + 1][j], table[i][j + 1])
    i = j = 0
    out = set()
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.add(i)
            i, j = i + 1, j + 1
        elif table[i + 1][j] >= table[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


@pytest.mark.parametrize("shard", [17, 64])
def test_whole_hosts_against_brute_force(spark, shard):
    rng = random.Random(8)
    rows, n = [], 0
    for host, size in (("small", 40), ("large", 400), ("one", 1)):
        for k in range(size):
            section = k // 10
            parts = ["<div>Site</div>", f"<div>Section {section}</div>", f"<p>Own {n}</p>", "".join(f"<p>Fact {rng.randrange(60)}</p>" for _ in range(3)), "<div>End</div>"]
            body = "".join(parts)
            if k % 7 == 3:
                body = rows[-1][2]  # a copy of the page before
            path = f"item?id={k:04}" if section % 2 else f"{section:03}/{k:04}"
            rows.append((n, f"http://{host}/{path}", f"<article>{body}</article>" if k % 5 == 0 else body))
            n += 1
    rng.shuffle(rows)
    got = texts(spark, rows, shard=shard)
    want = brute(rows, 8)
    assert len(got) == len(rows)
    # Lines that repeat in a page leave several longest subsequences, so those pages are compared by length.
    for i, text in got.items():
        page = next(r[2] for r in rows if r[0] == i)
        lines = [x.text for x in html_extract.lines(page)]
        assert text == want[i] or len(set(lines)) < len(lines) or len(text.split("\n")) == len(want[i].split("\n")), i


def test_host_size_changes_no_answer(spark):
    page = "<body><div>Site</div><div>Section {}</div><p>Own {}</p></body>"
    make = lambda host, n: [(n * 1000 + s * 40 + i, f"http://{host}/{s:02}/{i:02}", page.format(s, s * 40 + i)) for s in range(n // 40) for i in range(40)]
    rows = make("a", 40) + make("b", 400)
    got = texts(spark, rows)
    assert len(got) == 440 and all(text == f"Own {i % 1000}" for i, text in got.items())


def test_alignment_is_longest():
    mine = [f"{i % 7}" if i % 2 else f"a{i}" for i in range(5000)]
    other = [f"{i % 7}" if i % 3 else f"b{i}" for i in range(5000)]
    rng = random.Random(3)
    assert len(html_extract.shared(mine, other)) == int(html_extract.prefix_lengths(mine, other)[-1])
    for _ in range(60):
        a, b = ([rng.choice("abcd") for _ in range(30)] for _ in range(2))
        assert len(html_extract.shared(a, b)) == len(longest(a, b))


def test_very_long_pages_are_read_whole(spark):
    page = "<body><div>Site</div>" + "".join(f"<p>Line {{0}} {i}</p>" for i in range(20000)) + "<div>End</div></body>"
    got = texts(spark, [(i, f"http://h/{i}", page.format(i)) for i in range(3)])
    assert all(got[i].split("\n") == [f"Line {i} {k}" for k in range(20000)] for i in range(3))


@pytest.mark.parametrize("name", ["market-share", "social-history", "ad-hoc", "related-work", "skip-list", "notice-board", "widgets101"])
def test_topics_are_no_frame(name):
    for mark in (f"class='{name}'", f"class='x {name}'", f"id='{name}'", "id='comment-on-policy'"):
        assert main_lines(f"<article><p>One</p><div {mark}><p>Two</p></div></article>") == ["One", "Two"]


@pytest.mark.parametrize("name", ["share-bar", "social links", "ad", "ad-slot-3", "related-posts", "skip-link", "notice", "comment-list", "widget_box", "site-footer", "page-sidebar"])
def test_frames_by_name(name):
    assert main_lines(f"<article><p>One</p><div class='{name}'><p>Two</p></div></article>") == ["One"]


def test_a_thin_article_hides_nothing(spark):
    body = "<p>Main text of the page, long enough to be most of it</p>" * 3
    page = "<article class='teaser'><p>Teaser</p></article>" + body
    assert main_lines(page) == ["Teaser"] + ["Main text of the page, long enough to be most of it"] * 3
    assert main_lines("<div>Frame</div><article><p>Long enough an article here</p></article>") == ["Long enough an article here"]
