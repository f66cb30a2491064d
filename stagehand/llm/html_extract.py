"""Main text from HTML by nearest-URL page differencing.

A page is read into lines: the blocks of text that a browser would show, frame and all
(scripts and styles are no text). The pages of a host stand in the order of path, query
and id; each is compared with its ``NEIGHBOURS`` nearest pages of different content, at
most ``edge`` places away. Copies and near copies of a page (``ALIKE`` or more of the
longer text is shared) tell nothing of the frame, so they are passed over. Lines are
aligned by longest common subsequence in linear memory, and a line that enough neighbours
share is deleted: one neighbour is enough outside an article or main element, two are
needed for a line inside one, and all ``NEIGHBOURS`` for its paragraphs and titles, as
two or three articles may quote the same passage.

What differencing leaves is cleaned by elements: containers that are never main text
(menus, headers and footers of the page, sidebars, notices, adverts, forms, reader
comments, by element, role, class or id) go even where they differ from page to page, and
so does what stands outside the article element of a page that has one, unless it is thin
(under ``THIN`` of the page's text). Words that also name topics (share, related, social ...)
name such a container only alone or beside words of layout: ``share-bar``, not ``market-share``.

A host may hold any share of the pages: it is dealt in ranges of that order, each with the
``edge`` pages beyond its ends, so where a range ends changes no result. A task holds
2 * edge + 1 pages at a time. The driver gets three keys for each range of a large host,
and ranges grow so that there are at most ``most`` of them.

Defined cases: a null or empty page has no text; a page without a neighbour, or with copies
alone, is not differenced; pages of one URL are neighbours in the order of their ids; a
page of null URL has the host ''; repeated rows are copies, each with its own result; more
input columns, whatever their names, are ignored; an empty table gives an empty one;
unclosed and stray tags are tolerated; scripts, styles and comments are read to their end
or, if it is missing, the page's.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from itertools import zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import cut

#: HTML elements by their part in a page.
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
NEVER = set("applet aside audio button canvas datalist dialog fieldset footer form head iframe input map math menu meter nav noembed noframes noscript object optgroup option progress script select style svg template textarea title video".split())
RAW = set("script style noembed noframes iframe xmp".split())
ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
TOKENS = set("advert adverts advertisement advertising adbox adslot banner breadcrumb breadcrumbs comments commentlist consent cookie cookies copyright disqus footer gdpr masthead menu menubar modal nav navbar navigation newsletter notification popup promo promoted respond sidebar signup sponsor sponsored subscribe toolbar".split())
#: Words that name such a part only alone or beside words of layout, as they also name topics.
TOPICS = set("ad ads adv comment notice related share sharing skip social widget".split())
LAYOUT = set("area articles bar block bottom box button buttons container content count form group header holder icon icons inline inner item items left link links list main media nav network networks outer panel post posts right row section sidebar slot space sticky stories title to tools top unit wrap wrapper".split())
CLOSES_P = BLOCK - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "title"}
#: How many nearest pages of different content a page is compared with.
NEIGHBOURS = 4
#: An article with less than this share of a page's text doesn't hide the rest of it.
THIN = 1 / 3
#: Share of the longer page's characters from which two pages are near copies.
ALIKE = 0.9
SPACE = re.compile(r"\s+")


def is_frame(names: str | None) -> bool:
    """Whether a class or id attribute names a part that is never main text."""
    for name in (names or "").lower().split():
        words = set(re.findall(r"[a-z]+", name))
        if words & TOKENS or (words & TOPICS and words <= TOPICS | LAYOUT and words != {"skip", "list"}):
            return True
    return False


@dataclass(frozen=True)
class Line:
    text: str
    #: How many neighbours must share the line for it to go.
    need: int
    #: False in a container that is never main text, and outside the page's article.
    main: bool


class Reader(HTMLParser):
    """Collects (text, container, never main text) blocks; the container is "article", "paragraph" (one or a title in an article), "main" or "", from the stack of open elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, str]] = []  # element, never main text, container
        self.blocks: list[tuple[str, str, bool]] = []
        self.found = {"article": False, "main": False}
        self.text: list[str] = []
        self.raw = ""

    def state(self) -> tuple[bool, str]:
        return (self.open[-1][1], self.open[-1][2]) if self.open else (False, "")

    def flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.text)).strip()
        self.text = []
        if text:
            never, inside = self.state()
            if inside == "article" and not never and any(e in ("p", "h1") and i == "article" for e, _, i in self.open):
                inside = "paragraph"
            self.blocks.append((text, inside, never))

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK or tag in NEVER:
            self.flush()
        elif tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        if tag in CLOSES_P:
            self.close_open("p", {"article", "aside", "blockquote", "div", "li", "main", "section", "td", "th", "button"})
        if tag == "li":
            self.close_open("li", {"ul", "ol", "menu", "dir"})
        never, inside = self.state()
        found = dict(attrs)
        words = set(re.findall(r"[a-z0-9]+", f"{found.get('class') or ''} {found.get('id') or ''}".lower()))
        bad = tag in NEVER or (tag == "header" and not inside) or (found.get("role") or "").lower() in ROLES or "hidden" in found
        if tag not in ("html", "body", "article", "main", "h1", "p"):
            bad = bad or is_frame(found.get("class")) or is_frame(found.get("id"))
        if tag in ("article", "main") and not never and not bad:
            if not (words & {"comment", "comments"} or inside):
                inside = tag
                self.found[tag] = True
            elif words & {"comment", "comments"}:
                bad = True
        self.open.append((tag, never or bad, inside))
        if tag in RAW:
            self.raw = tag

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "math"):
            self.handle_endtag(tag)

    def close_open(self, tag: str, until: set[str]) -> None:
        """Closes the innermost open ``tag`` unless an element of ``until`` stands within it."""
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self.flush()
                del self.open[i:]
                return
            if self.open[i][0] in until:
                return

    def handle_endtag(self, tag):
        if tag == self.raw:
            self.raw = ""
        if tag in BLOCK or tag in NEVER:
            self.flush()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return
            if self.open[i][0] in ("article", "main", "nav", "aside", "footer", "form", "body") and tag not in ("article", "main", "nav", "aside", "footer", "form", "body", "html", "div", "section"):
                return

    def handle_data(self, data):
        if not self.raw:
            self.text.append(data)


def lines(html: str | None) -> list[Line]:
    """The lines of a page, in page order."""
    reader = Reader()
    reader.feed(html or "")
    HTMLParser.close(reader)  # what is still buffered
    reader.flush()
    size = lambda *kinds: sum(len(text) for text, inside, never in reader.blocks if not never and (inside in kinds or not kinds))
    thin = size("article", "paragraph") < THIN * size()
    home = ("article", "paragraph", "main", "") if thin else ("article", "paragraph") if reader.found["article"] else ("main",) if reader.found["main"] else ("",)
    needs = {"paragraph": NEIGHBOURS, "article": 2, "main": 2}
    return [Line(text, 1 if never else needs.get(inside, 1), not never and inside in home) for text, inside, never in reader.blocks]


def prefix_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of ``a`` and every prefix of ``b``, with bits for ``b``'s lines."""
    at: dict[str, int] = {}
    for i, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & at.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def aligned(a: list[str], b: list[str]) -> set[int]:
    """Places in ``a`` of a longest common subsequence, in linear memory (Hirschberg)."""
    found, todo = set(), [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 == a1 or b0 == b1:
            continue
        if a1 - a0 == 1:
            if a[a0] in b[b0:b1]:
                found.add(a0)
            continue
        middle = (a0 + a1) // 2
        ahead = prefix_lengths(a[a0:middle], b[b0:b1])
        back = prefix_lengths(a[middle:a1][::-1], b[b0:b1][::-1])[::-1]
        cut_at = b0 + int(np.argmax(ahead + back))
        todo += [(a0, middle, b0, cut_at), (middle, a1, cut_at, b1)]
    return found


def shared(mine: list[str], other: list[str]) -> set[int]:
    """Places in ``mine`` of the lines that align with ``other``'s in a longest common subsequence."""
    low = 0
    while low < min(len(mine), len(other)) and mine[low] == other[low]:
        low += 1
    high = 0
    while high < min(len(mine), len(other)) - low and mine[-1 - high] == other[-1 - high]:
        high += 1
    found = {*range(low), *range(len(mine) - high, len(mine))}
    a, b = mine[low : len(mine) - high], other[low : len(other) - high]
    common = set(a) & set(b)
    # Lines of one page only can't align.
    at = [i for i, x in enumerate(a) if x in common]
    return found | {low + at[i] for i in aligned([a[i] for i in at], [x for x in b if x in common])}


class Page:
    """A page's lines, and those that may be main text for telling copies."""

    def __init__(self, html: str | None):
        self.lines = lines(html)
        self.texts = [x.text for x in self.lines]
        self.body = [x.text for x in self.lines if x.main]
        self.size = sum(map(len, self.body))
        self.known = set(self.body)

    def alike(self, other: Page) -> bool:
        """Whether two pages are copies or near copies."""
        if self.body == other.body:
            return True
        low, high = sorted((self.size, other.size))
        if low < ALIKE * high or sum(len(x) for x in self.body if x in other.known) < ALIKE * high:
            return False
        return sum(len(self.body[i]) for i in shared(self.body, other.body)) >= ALIKE * high


def nearest(page: Page, before: list[Page], after: list[Page]) -> list[Page]:
    """Of the pages ``before`` and ``after`` (nearest first) the nearest that are near copies neither of the page nor of each other."""
    found: list[Page] = []
    for side in zip_longest(before, after):
        for p in side:
            if p is not None and not any(p.alike(x) for x in (page, *found)):
                found.append(p)
                if len(found) == NEIGHBOURS:
                    return found
    return found


def difference(page: Page, neighbours: list[Page]) -> list[Line]:
    """The page's lines without those that enough of its neighbours share."""
    times = [0] * len(page.lines)
    for n in neighbours:
        for i in shared(page.texts, n.texts):
            times[i] += 1
    return [x for x, n in zip(page.lines, times) if n < x.need]


def main_text(page: Page, neighbours: list[Page]) -> str:
    return "\n".join(x.text for x in difference(page, neighbours) if x.main)


def order_of(path: str, query: str, page, url: str | None) -> tuple:
    """The place of a page in its host, as Spark sorts it: nulls first."""
    return path, query, (page is not None, page), (url is not None, url)


def ranges(pages: DataFrame, shard: int, edge: int, most: int) -> dict[str, tuple[list, list, list]]:
    """For hosts of more than a range: where each next range starts, and where the ``edge`` pages before and after that start begin and end.

    A range is of ``shard`` pages, or of as many more as keep the ranges under ``most``.
    """
    order = ["_host", "_path", "_query", "_id", "_url"]
    sizes = cut(pages.groupBy("_host").agg(F.count("*").alias("_pages")))
    total, hosts = sizes.filter(F.col("_pages") > shard).agg(F.coalesce(F.sum("_pages"), F.lit(0)), F.count("*")).first()
    if not hosts:
        return {}
    shard = max(shard, -(-total // most))
    # The same join at every size: hosts grow with the input.
    keys = pages.select(*order).join(sizes.filter(F.col("_pages") > shard).select("_host").hint("merge"), "_host", "left_semi")
    rows = cut(keys.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    before = Window.partitionBy("_host").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("_host", "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    offsets = offsets.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).select("_host", "_part", "_shift")
    ranked = rows.join(offsets, ["_host", "_part"]).withColumn("_rank", F.col("_row") + F.col("_shift"))
    found: dict[str, tuple[list, list, list]] = {}
    place = F.col("_rank") % shard
    for r in ranked.filter(place.isin(0, edge, shard - edge)).select(*order, "_rank").collect():
        kind = {0: 0, shard - edge: 1, edge: 2}[r["_rank"] % shard]
        if r["_rank"] >= shard or kind == 1:
            found.setdefault(r["_host"], ([], [], []))[kind].append(order_of(r["_path"], r["_query"], r["_id"], r["_url"]))
    return {host: tuple(map(sorted, every)) for host, every in found.items()}


def place(pages: DataFrame, url_col: str, shard: int, edge: int, most: int) -> DataFrame:
    """Adds ``_host``, ``_path``, ``_query``, ``_shard`` and ``_own``: large hosts are dealt by ranges of their order; the ``edge`` pages beyond a range come as copies that aren't its own."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    start = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//"
    pages = pages.withColumn("_host", F.lower(F.regexp_extract(url, start + "([^/?#]*)", 1)))
    pages = pages.withColumn("_path", F.regexp_replace(url, start + "[^/?#]*|[?#].*$", "")).withColumn("_query", F.regexp_extract(url, r"\?([^#]*)", 1))
    known = ranges(pages, shard, edge, most)
    if not known:
        return pages.withColumn("_shard", F.lit(0)).withColumn("_own", F.lit(True))

    def deal(host, path, query, page, url):
        if host not in known:
            return [(0, True)]
        key, (starts, begins, ends) = order_of(path, query, page, url), known[host]
        own = bisect_right(starts, key)
        # Past the begin of the next range's copies, or before the end of those of the range before.
        after = [(own + 1, False)] if own < len(starts) and bisect_right(begins, key) > own else []
        return [(own, True), *after, *([(own - 1, False)] if own and bisect_right(ends, key) < own else [])]

    dealt = F.udf(deal, "array<struct<_shard:int,_own:boolean>>")("_host", "_path", "_query", "_id", url_col)
    return pages.withColumn("_d", F.explode(dealt)).select(*pages.columns, "_d.*")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", shard: int = 128, edge: int = 8, most: int = 50_000) -> DataFrame:
    """(id, url, ``text``, ``n_chars``) of every page."""
    if shard < 2 * edge + 1:
        raise ValueError("a range must hold more than its two edges")
    placed = place(pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html")), "_url", shard, edge, most)
    order = ["_host", "_shard", "_path", "_query", "_id", "_url"]
    ordered = placed.repartition("_host", "_shard").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        for row in windows(rows for b in batches for rows in zip(*(c.to_pylist() for c in b.columns))):
            done.append(row)
            if len(done) == 256:
                yield out(done)
                done = []
        yield out(done)

    def windows(rows: Iterator[tuple]) -> Iterator[tuple]:
        held: list[tuple] = []  # own, id, url, page: the last pages of the range, at most 2 * edge + 1
        at, group = 0, None  # the next of them to be done
        for host, part, own, i, url, html in rows:
            if group != (host, part):
                while at < len(held):
                    yield from finish(held, at)
                    at += 1
                held, at, group = [], 0, (host, part)
            held.append((own, i, url, Page(html)))
            if len(held) - 1 - at == edge:
                yield from finish(held, at)
                at += 1
            if at > edge:
                del held[0]
                at -= 1
        while at < len(held):
            yield from finish(held, at)
            at += 1

    def finish(held: list[tuple], at: int) -> Iterator[tuple]:
        own, i, url, page = held[at]
        if own:
            near = [p for *_, p in held]
            text = main_text(page, nearest(page, near[max(0, at - edge) : at][::-1], near[at + 1 : at + 1 + edge]))
            yield i, url, text, len(text)

    schema = T.StructType([T.StructField(id_col, pages.schema[id_col].dataType), T.StructField(url_col, T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    types = to_arrow_schema(schema)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, types)], schema=types)

    return ordered.select("_host", "_shard", "_own", "_id", "_url", "_html").mapInArrow(run, schema)
