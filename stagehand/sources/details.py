"""Copy and dates of detail pages, and listings of pages without cards.

A page's tree is walked in a pandas or Arrow UDF, which returns flat nodes; what to keep is
decided by built-in functions over them. Null pages have no nodes. Pages of one template,
which differ in texts and in values of two attributes only, share the walk of their outline.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from html import unescape
from itertools import product
from operator import itemgetter
from urllib.parse import urljoin

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stagehand.functions import linked, markup, text
from stagehand.functions.columns import filled, let, squeeze
from stagehand.functions.dates import iso_day, parse_range
from stagehand.functions.text import cleaned, suspect
from stagehand.operators.windows import plausible

#: Where the copy of a page is, and headings that it stands under.
ROOTS = "article, main, [role='main'], .entry-content"
PLOT_HEADINGS = {"synopsis", "about the show", "about the production", "the story", "the plot"}
HEADINGS = ("h1", "h2", "h3", "h4", "h5")


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


TEXT, FLAG = T.StringType(), T.BooleanType()
COPY = T.ArrayType(_struct(text=TEXT, kind=TEXT, quoted=FLAG, leaf=FLAG, below=FLAG, suspect=FLAG))
STAMPED = _struct(stamps=T.ArrayType(TEXT), text=TEXT)
BOXES = T.ArrayType(_struct(pos=T.IntegerType(), text=TEXT, head=FLAG, short=FLAG, href=TEXT, own=T.ArrayType(_struct(text=TEXT, href=TEXT))))


def _inside(node: markup.Node, *tags: str) -> list[markup.Node]:
    return [n for n in node.below() if n.tag in tags]


def _quoted(p: markup.Node) -> bool:
    """In a block quotation, or all of it one italic element."""
    up = p.parent
    while up is not None:
        if up.tag == "blockquote":
            return True
        up = up.parent
    solid = [c for c in p.inside if isinstance(c, markup.Node) or c.strip()]
    return len(solid) == 1 and isinstance(solid[0], markup.Node) and solid[0].tag in ("em", "i")


def _copy(whole: markup.Node) -> list[tuple]:
    """(text, kind, quoted, leaf, below) of paragraphs and font elements."""
    root = markup.first(whole, ROOTS)
    if root is None or not _inside(root, "p"):
        root = whole
    out, below = [], False
    for n in root.below():
        if n.tag in ("h2", "h3", "h4"):
            below = below or " ".join(n.text().split()).lower() in PLOT_HEADINGS
        elif n.tag in ("p", "font"):
            out.append((unescape(unescape(n.text())), n.tag, _quoted(n), not _inside(n, n.tag), below))
    return out


def _copies(copies: list[list[tuple]]) -> pa.Array:
    """The lists of ``COPY``, their texts with clean spaces."""
    nodes = [n for nodes in copies for n in nodes]
    said, *rest = ([n[i] for n in nodes] for i in range(5))
    said = cleaned(pa.array(said, pa.string()))
    columns = [said, *[pa.array(x, kind) for x, kind in zip(rest, (pa.string(), pa.bool_(), pa.bool_(), pa.bool_()), strict=True)], suspect(said)]
    ends = np.cumsum([0, *map(len, copies)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, names=COPY.elementType.names))


@F.arrow_udf(COPY)
def copy_nodes(pages: pa.Array) -> pa.Array:
    """Paragraphs and font elements of the part of each page that holds its copy, in page order, with clean spaces."""
    return _copies([_copy(markup.tree(page or "")) for page in pages.to_pylist()])


def synopsis(page: Column, title: Column, most: int = 3) -> Column:
    """``synopsis_of`` a page's nodes."""
    return synopsis_of(copy_nodes(page), title, most)


def synopsis_of(nodes: Column, title: Column, most: int = 3) -> Column:
    """Up to ``most`` paragraphs of copy, joined by an empty line; null if there are none.

    Paragraphs below a heading of the plot are preferred to all, those without paragraphs
    inside to the others, prose to quotations; font elements are read if no paragraph is kept.
    A leading epigraph goes if more follows.
    """
    def good(name: Column):
        def judged(n: Column) -> Column:
            said = n["text"]
            return (F.length(said) >= 50) & ~text.is_shouted(said) & ~(n["suspect"] & (text.is_chrome(said) | text.is_credits(said))) & ~text.mostly_title(said, name)

        return judged

    def shaped(n: Column) -> Column:
        said = F.when(n["suspect"], F.trim(F.regexp_replace(n["text"], text.PRESENTS, ""))).otherwise(n["text"])
        return F.struct(said.alias("said"), *[n[k].alias(k) for k in ("kind", "quoted", "leaf", "below")])

    def kept(nodes: Column, fits) -> Column:
        def once(said: Column) -> Column:
            return F.slice(F.filter(said, lambda p, i: (i == 0) | (p != F.get(said, i - 1))), 1, most + 1)

        def led(some: Column) -> Column:
            more = F.when((F.size(some) > 1) & text.opens_as_epigraph(F.get(some, 0)), F.slice(some, 2, most)).otherwise(F.slice(some, 1, most))
            return F.when(F.size(some) > 0, more)

        return let(let(F.transform(F.filter(nodes, fits), lambda n: n["said"]), once), led)

    def paragraph(below: bool, leaf: bool, prose: bool):
        always = F.lit(True)
        return lambda n: (n["kind"] == "p") & (n["below"] if below else always) & (n["leaf"] if leaf else always) & (~n["quoted"] if prose else always)

    def choose(nodes: Column) -> Column:
        ways = [paragraph(*way) for way in product((True, False), repeat=3)]
        ways.append(lambda n: (n["kind"] == "font") & n["leaf"])
        return F.array_join(F.coalesce(*[kept(nodes, w) for w in ways]), "\n\n")

    given = F.struct(nodes.alias("nodes"), squeeze(F.coalesce(title, F.lit(""))).alias("name"))
    return let(let(given, lambda v: F.transform(F.filter(v["nodes"], good(v["name"])), shaped)), choose)


@F.pandas_udf(STAMPED)
def _stamped(pages: pd.Series, selectors: pd.Series) -> pd.DataFrame:
    told = (_stamps(markup.tree(page or ""), selector) for page, selector in zip(pages, selectors, strict=True))
    return pd.DataFrame([([s[:10] for s in stamps], said) for stamps, said in told], columns=["stamps", "text"])


def _stamps(root: markup.Node, selector: str | None) -> tuple[list[str], str | None]:
    node = markup.first(root, selector) if selector else None
    if node is None:
        return [], None
    return [n.attrs["datetime"] for n in (node, *node.below()) if n.attrs.get("datetime")], node.text()


def detail_dates(page: Column, selector: Column, as_of: Column) -> Column:
    """``dates_of`` the first element of a page that fits."""
    return dates_of(_stamped(page, selector), as_of)


def dates_of(stamped: Column, as_of: Column) -> Column:
    """(first_date, last_date) of an element: its ISO ``datetime`` attributes, or else its text."""

    def read(found: Column) -> Column:
        def told(days: Column) -> Column:
            ends = F.struct(F.get(days, 0).alias("first_date"), F.get(days, F.size(days) - 1).alias("last_date"))
            return F.when(F.size(days) > 0, ends).otherwise(parse_range(found["text"], as_of))

        return let(F.filter(F.transform(F.filter(found["stamps"], lambda s: s.rlike(r"^\d{4}-\d\d-\d\d$")), iso_day), lambda d: d.isNotNull()), told)

    return let(stamped, read)


def _slug(said: str) -> str:
    return re.sub("[^a-z0-9]+", "", said.lower())


def _href(node: markup.Node, climb: int = 8) -> str | None:
    """A link in the nearest of ``climb`` elements around a title that has one: the first whose last part looks like the title, else the first."""
    title, at = _slug(node.text()), node.parent
    for _ in range(climb):
        if at is None or at.tag in ("body", "html"):
            return None
        hrefs = [h for n in _inside(at, "a") if (h := n.attrs.get("href")) is not None and not h.startswith(("#", "mailto:", "tel:", "javascript:"))]
        if hrefs:
            ends = ((h, _slug(h.rstrip("/").rsplit("/", 1)[-1])) for h in hrefs)
            return next((h for h, s in ends if min(len(s), len(title)) >= 6 and (title[:8] in s or s[:8] in title)), hrefs[0])
        at = at.parent
    return None


def _boxes(page: str | None, longest: int = 80) -> list[dict]:
    out = []
    for pos, n in enumerate(markup.tree(page or "").below()):
        if n.tag not in (*HEADINGS, "p", "span", "time", "div"):
            continue
        said = n.text()
        head = n.tag in HEADINGS
        if said and (head or len(said) <= longest):
            own = [{"text": h.text(), "href": _href(h)} for h in _inside(n, *HEADINGS)] if len(said) <= longest else []
            out.append({"pos": pos, "text": said, "head": head, "short": len(said) <= longest and n.tag != "h1", "href": _href(n) if head else None, "own": own})
    return out


@F.pandas_udf(BOXES)
def boxes(pages: pd.Series) -> pd.Series:
    """Headings and short texts of each page, with the links of the headings."""
    return pages.map(_boxes)


@F.pandas_udf(TEXT)
def absolute(bases: pd.Series, links: pd.Series) -> pd.Series:
    """Links resolved against their pages."""
    return pd.Series([urljoin(b, x) if x else b for b, x in zip(bases, links, strict=True)])


def dated_clusters(venues: DataFrame, pages: DataFrame, as_of: Column) -> DataFrame:
    """Rows of short dated texts, each with the first title inside it or the last one before it, and a link near the title; one row a title and start.

    Windows are by venue: no larger than one page.
    """
    at = venues.select(F.col("id").alias("venue_id"), "whats_on_url").join(pages.select("url", "body"), F.col("whats_on_url") == F.col("url"))
    nodes = at.select("venue_id", "whats_on_url", F.explode(boxes("body")).alias("n")).select("venue_id", "whats_on_url", "n.*").withColumn("w", parse_range(F.col("text"), as_of))
    titled = lambda t: text.looks_like_title(t, parse_range(t, as_of)["first_date"])
    before = Window.partitionBy("venue_id", "whats_on_url").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    title = F.when(F.col("head") & text.looks_like_title(F.col("text"), F.col("w.first_date")), F.struct("text", "href"))
    inner = F.get(F.filter("own", lambda t: titled(t["text"])), 0)
    rows = nodes.withColumn("t", F.coalesce(inner, F.last(title, ignorenulls=True).over(before))).filter(F.col("short") & F.col("w.first_date").isNotNull() & F.col("t.href").isNotNull())
    once = Window.partitionBy("venue_id", F.lower("t.text"), "w.first_date").orderBy("pos")
    first = rows.withColumn("_n", F.row_number().over(once)).filter("_n = 1")
    return first.select("venue_id", F.col("pos").cast("long").alias("pos"), F.col("t.text").alias("title"), F.lit(None).cast("string").alias("credits"), absolute("whats_on_url", "t.href").alias("url"), "w.first_date", "w.last_date", F.lit(None).cast("string").alias("description"), F.lit("dated_clusters").alias("source"))


#: Names of meta elements, the first that says something wins.
META_TITLE = ("og:title", "twitter:title")
META_COPY = ("og:description", "twitter:description", "description")
PARTS = _struct(meta_title=TEXT, heading=TEXT, meta_copy=TEXT, text=TEXT, copy=COPY, stamped=STAMPED)


def _meta(every: list[markup.Node], *names: str) -> str | None:
    """The content of the first named of some meta elements that has one, by property or else by name."""
    for name in names:
        found = next((n for key in ("property", "name") for n in every if n.attrs.get(key) == name), None)
        if found is not None and found.attrs.get("content"):
            return found.attrs["content"]
    return None


def _parts(root: markup.Node, selector: str | None) -> tuple:
    nodes = root.below()
    heading = next((n for n in nodes if n.tag == "h1"), None)
    every = [n for n in nodes if n.tag == "meta"]
    stamps, said = _stamps(root, selector)
    return _meta(every, *META_TITLE), heading.text() if heading else None, _meta(every, *META_COPY), root.text(), said, stamps, _copy(root)


def _form(said: str | None) -> Callable[[list[str]], str | None]:
    """What puts a page's values into the places of a text."""
    plain, *rest = markup.PLACE.split(said or "")
    if not rest:
        return lambda values: said
    pick, form = itemgetter(*map(int, rest[::2])), "%s".join(x.replace("%", "%%") for x in (plain, *rest[1::2]))
    return lambda values: form % pick(values)


def _template(frame: str, selector: str | None) -> Callable[[list[str]], tuple] | None:
    """``_parts`` of the pages of an outline, of which only the values are read; None if the tree is needed."""
    root = markup.framed(frame)
    if root is None:
        return None
    *said, stamps, copy = _parts(root, selector)
    said, stamps, copy = [_form(s) for s in said], [_form(s) for s in stamps], [(_form(n[0]), n[1:]) for n in copy]
    return lambda values: (*[f(values) for f in said], [f(values) for f in stamps], [(f(values), *rest) for f, rest in copy])


def _read(page: str, selector: str | None, known: dict, most: int = 128) -> tuple:
    """``_parts`` of a page, by the template of its outline, of which ``most`` are ``known`` at a time; a selector of attributes or texts needs the tree."""
    if (selector is None or not ("[" in selector or ":" in selector)) and (outline := markup.outline(page)) is not None:
        frame, values = outline
        if (frame, selector) not in known:
            if len(known) >= most:
                known.clear()
            known[frame, selector] = _template(frame, selector)
        if (form := known[frame, selector]) is not None:
            return form(values)
    return _parts(markup.tree(page), selector)


@F.arrow_udf(PARTS)
def page_parts(pages: pa.Array, selectors: pa.Array) -> pa.Array:
    """Of each page, read once: meta title, first main heading, meta description and text, its ``copy_nodes``, and the element of the selector."""
    known = {}
    read = [_read(page or "", selector, known) for page, selector in zip(pages.to_pylist(), selectors.to_pylist(), strict=True)]
    title, heading, meta, whole, said, stamps, copies = ([r[i] for r in read] for i in range(7))
    strip = lambda texts: [t and t.strip() for t in texts]
    days = [[s[:10] for s in some] for some in stamps]
    stamped = pa.StructArray.from_arrays([pa.array(days, pa.list_(pa.string())), pa.array(said, pa.string())], names=STAMPED.names)
    columns = [*[pa.array(x, pa.string()) for x in (strip(title), heading, strip(meta), whole)], _copies(copies), stamped]
    return pa.StructArray.from_arrays(columns, names=PARTS.names)


def full_title(facts: Column) -> Column:
    """The page's own title without the site's name: the meta title, or the heading if that is cut short."""
    def shown(said: Column) -> Column:
        return F.trim(F.get(F.split(text.clean_spaces(F.coalesce(said, F.lit(""))), r"\s+[|\u2013\u2014]\s+", 2), 0))

    return F.get(F.filter(F.transform(F.array(facts["meta_title"], facts["heading"]), shown), lambda t: filled(t) & ~text.is_truncated(t)), 0)


def prices(said: Column) -> Column:
    """(price_min, price_max) of the amounts in pounds that a text names; null without any."""
    found = F.transform(F.regexp_extract_all(said, F.lit(r"\u00a3\s?(\d+(?:\.\d{2})?)"), F.lit(1)), lambda p: p.cast("double"))
    return let(found, lambda ps: F.struct(F.array_min(ps).alias("price_min"), F.array_max(ps).alias("price_max")))


def facts_of(pages: DataFrame, as_of: Column, title: str = "title", selector: str | None = None) -> DataFrame:
    """``pages`` (with ``body``) with ``d``: what a show's page says of its dates, title, copy and prices.

    Linked data come first, if their run is plausible, then the element of ``selector``; the copy is
    the best of synopsis, linked data and a meta description that names the show.
    """
    rows = pages.withColumn("_l", F.get(linked.events(linked.nodes(F.col("body"), "type", "start", "end", "description", "price")), 0)).withColumn("_f", page_parts("body", F.col(selector) if selector else F.lit(None).cast("string")))
    rows = rows.withColumns({"_s": synopsis_of(F.col("_f.copy"), F.col(title)), "_p": prices(F.col("_f.text"))})
    start, end = iso_day(F.col("_l.start")), iso_day(F.col("_l.end"))
    linked_run = F.when(plausible(start, end), F.struct(start.alias("first_date"), end.alias("last_date")))
    rows = rows.withColumn("_r", linked_run)
    rows = rows.withColumn("_w", F.when(F.col("_r.first_date").isNull(), dates_of(F.col("_f.stamped"), as_of)) if selector else F.lit(None).cast("struct<first_date:date,last_date:date>"))
    written_run = F.when(F.col("_w.first_date").isNotNull() & plausible(F.col("_w.first_date"), F.col("_w.last_date")), F.col("_w"))
    run = F.when(F.col("_r.first_date").isNotNull() | written_run.isNull(), F.col("_r")).otherwise(written_run)
    named, price = F.col("_p"), F.col("_l.price").try_cast("double")
    told = F.struct(
        run["first_date"].alias("first_date"), run["last_date"].alias("last_date"), full_title(F.col("_f")).alias("full_title"),
        text.pick_description(F.col("_s"), F.col("_l.description"), text.og_for_show(F.col("_f.meta_copy"), F.col(title))).alias("description"),
        F.coalesce(price, named["price_min"]).alias("price_min"), F.when(price.isNull(), named["price_max"]).alias("price_max"),
    )
    return rows.withColumn("d", told).drop("_f", "_l", "_s", "_p", "_r", "_w")


def wants_detail(url: Column, listing: Column, description: Column, first_date: Column) -> Column:
    """Whether a row's own page is worth a look: it has one, and the copy isn't full or the dates are missing."""
    bare = lambda u: F.rtrim(F.coalesce(u, F.lit("")), F.lit("/"))
    return (bare(url) != "") & (bare(url) != bare(listing)) & (~text.is_full_synopsis(description) | first_date.isNull())


def folded(row, detail: Column) -> dict[str, Column]:
    """Columns of a listing with its page folded in: the longer copy, the page's title for one cut short, other fields where the listing has none.

    ``row`` gives a listing's column by name.
    """
    longer = detail["description"].isNotNull() & (F.length(detail["description"]) > F.length(F.coalesce(row("description"), F.lit(""))))
    out = {
        "description": F.when(longer, detail["description"]).otherwise(row("description")),
        "title": F.when(detail["full_title"].isNotNull() & text.is_truncated(row("title")), detail["full_title"]).otherwise(row("title")),
    }
    for name in ("first_date", "last_date"):
        out[name] = F.coalesce(row(name), detail[name])
    for name in ("price_min", "price_max"):
        out[name] = F.coalesce(F.nullif(row(name), F.lit(0.0)), detail[name], row(name))
    return out


def hop(rows: DataFrame, venues: DataFrame, pages: DataFrame, as_of: Column) -> DataFrame:
    """Listing rows with their own pages folded in, where those are wanted and ``pages`` (url, body) has them.

    Only rows that want a page meet the table of pages; the others pass by the join.
    """
    of = venues.select(F.col("id").alias("venue_id"), F.col("whats_on_url").alias("_on"), F.coalesce("skip_stage2", F.lit(False)).alias("_skip"), F.col("detail_dates").alias("_selector"))
    marked = rows.join(of, "venue_id", "left").withColumn("_wants", ~F.coalesce("_skip", F.lit(False)) & wants_detail(F.col("url"), F.col("_on"), F.col("description"), F.col("first_date")))
    asked = marked.filter("_wants").withColumn("_key", F.rtrim("url", F.lit("/")))
    latest = pages.select(F.rtrim("url", F.lit("/")).alias("_key"), "body").groupBy("_key").agg(F.min("body").alias("body"))
    told = facts_of(asked.join(latest, "_key", "left"), as_of, "title", "_selector")
    shown = told.select(*[folded(F.col, F.col("d")).get(c, F.col(c)).alias(c) for c in rows.columns])
    return shown.unionByName(marked.filter("not _wants").select(*rows.columns))
