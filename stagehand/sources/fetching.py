"""Polite fetching of pages: what the table of pages has fresh isn't asked for, and each host is asked by one task, with pauses.

``requests`` has ``url``, ``rendered`` (whether the page needs a browser) and maybe ``wait`` (a selector that a rendered page is waited for); a plain and a
rendered copy of one url are different pages. Fetched pages are ``PAGE`` rows. Null and empty urls are left out,
a url asked for twice is fetched once, and a page that fails has its ``error`` and no body.

A host's requests are one after the other, as politeness asks, so the longest host tells how long a
crawl takes at least; hosts of one task take turns, and a pause counts from the last answer of the same host.
Bodies pass through a task in small frames and are never gathered. A task that is lost asks its hosts again. Speculative
execution would ask a host twice at once: leave it off in a crawl.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagehand.functions.columns import filled
from stagehand.sources import details, sinks
from stagehand.sources.probes import SITEMAPS, root

#: Hours that a listing and a show's own page stay fresh, seconds between two requests to a host, plain and rendered, and of waiting for an answer.
LISTING_HOURS, DETAIL_HOURS = 12, 720
PAUSE, RENDER_PAUSE, TIMEOUT = 1.5, 3.0, 25
PAGE = "url string, rendered boolean, final_url string, status int, body string, error string, fetched_at timestamp"
AGENT = "Mozilla/5.0 (compatible; stagehand)"
#: A way to get a page: a url to (final url, status, body); what it raises becomes the page's error.
Get = Callable[[str], tuple[str, int, str]]
#: The same of a page and the selector to wait for, None to wait for nothing.
Render = Callable[[str, str | None], tuple[str, int, str]]


def plain(url: str) -> tuple[str, int, str]:
    """A page over HTTP."""
    if urlsplit(url).scheme not in ("http", "https"):
        raise ValueError(f"not a web address: {url}")
    asked = urllib.request.Request(url, headers={"User-Agent": AGENT})
    with urllib.request.urlopen(asked, timeout=TIMEOUT) as answer:
        return answer.geturl(), answer.status, answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")


def needs_browser(venues: DataFrame) -> Column:
    return F.coalesce(venues["fetch_method"].isin("rendered", "js_rendered"), F.lit(False)) | F.coalesce(_setting(venues, "render", "boolean"), F.lit(False))


def _setting(venues: DataFrame, name: str, kind: str) -> Column:
    """A setting that not every registry has."""
    return venues[name] if name in venues.columns else F.lit(None).cast(kind)


def waits_for(venues: DataFrame) -> Column:
    """The selector that a rendered listing is waited for; pages of shows are rendered without waiting, as they don't have it."""
    return F.when(needs_browser(venues), F.nullif(_setting(venues, "render_wait", "string"), F.lit("")))


def of_listings(venues: DataFrame) -> DataFrame:
    """Requests for the listing pages and API answers of venues."""
    wanted = F.when(F.col("strategy").isin("wp_rest", "sanity") & filled(F.col("endpoint")), F.col("endpoint")).otherwise(F.col("whats_on_url"))
    return venues.select(wanted.alias("url"), needs_browser(venues).alias("rendered"), waits_for(venues).alias("wait")).filter(filled(F.col("url")))


def rest_index(url: Column) -> Column:
    """Where a site's REST index of types would be."""
    return F.concat(root(url), F.lit("/wp-json/wp/v2/types"))


def of_probes(venues: DataFrame) -> DataFrame:
    """Requests for what probes look at: listing pages, and REST indexes and sitemaps of their sites, which need no browser."""
    at = venues.select(F.col("whats_on_url").alias("url")).filter(filled(F.col("url")))
    aside = at.select(F.explode(F.array(rest_index(F.col("url")), *[F.concat(root(F.col("url")), F.lit(p)) for p in SITEMAPS])).alias("url"), F.lit(False).alias("rendered"), F.lit(None).cast("string").alias("wait"))
    return of_listings(venues).unionByName(aside)


def of_details(rows: DataFrame, venues: DataFrame) -> DataFrame:
    """Requests for the own pages of listing rows that want them."""
    of = venues.select(F.col("id").alias("venue_id"), F.col("whats_on_url").alias("_on"), F.coalesce("skip_stage2", F.lit(False)).alias("_skip"), needs_browser(venues).alias("rendered"))
    marked = rows.select("venue_id", "url", "description", "first_date").join(of, "venue_id")
    return marked.filter(~F.col("_skip") & details.wants_detail(F.col("url"), F.col("_on"), F.col("description"), F.col("first_date"))).select("url", "rendered", F.lit(None).cast("string").alias("wait"))


def due(requests: DataFrame, pages: DataFrame, as_of: Column, hours: int) -> DataFrame:
    """Distinct requests without a page fetched within ``hours`` of ``as_of``; failed fetches don't count. Of requests for one page that wait for different things the first selector stays."""
    recent = pages.filter((F.col("fetched_at") > as_of - F.make_interval(hours=F.lit(hours))) & F.col("error").isNull())
    return _once(requests.filter(filled(F.col("url")))).join(recent.select("url", "rendered"), ["url", "rendered"], "left_anti")


def _once(requests: DataFrame) -> DataFrame:
    """One request a page, with what it waits for if requests tell."""
    if "wait" not in requests.columns:
        return requests.select("url", "rendered").distinct()
    return requests.groupBy("url", "rendered").agg(F.min("wait").alias("wait"))


def fetch(requests: DataFrame, tasks: int, get: Get = plain, render: Render | None = None, pauses: tuple[float, float] = (PAUSE, RENDER_PAUSE)) -> DataFrame:
    """``PAGE`` rows of distinct ``requests``, fetched by ``tasks`` tasks dealt by host. ``render`` gets rendered pages, told what to wait for; without one they fail."""
    def one(url: str, rendered: bool, wait: str | None, last: dict[str, float]) -> tuple:
        host, pause = urlsplit(url).netloc, pauses[bool(rendered)]
        time.sleep(max(0.0, last.get(host, -pause) + pause - time.monotonic()))
        try:
            if rendered and render is None:
                raise RuntimeError("no browser to render with")
            final, status, body = render(url, wait) if rendered else get(url)
            out = (url, rendered, final, status, body, None)
        except urllib.error.HTTPError as e:
            out = (url, rendered, e.url, e.code, None, f"HTTP {e.code}")
        except Exception as e:  # what a site or an injected browser raises isn't known
            out = (url, rendered, None, None, None, f"{type(e).__name__}: {e}")
        last[host] = time.monotonic()
        return (*out, pd.Timestamp.now(tz="UTC"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[str, float] = {}
        for frame in frames:
            for url, rendered, wait in zip(frame["url"], frame["rendered"], frame["wait"]):
                yield pd.DataFrame([one(url, rendered, wait, last)], columns=[c.split()[0] for c in PAGE.split(", ")])

    turns = Window.partitionBy("_host").orderBy("url", "rendered")
    told = requests if "wait" in requests.columns else requests.withColumn("wait", F.lit(None).cast("string"))
    dealt = _once(told).withColumn("_host", root(F.col("url"))).repartition(tasks, "_host").withColumn("_turn", F.row_number().over(turns))
    return dealt.sortWithinPartitions("_turn", "_host").select("url", "rendered", "wait").mapInPandas(run, PAGE)


def refresh(requests: DataFrame, path: str, as_of: Column, hours: int, tasks: int, **ways) -> None:
    """Fetches what is ``due`` of ``requests`` and appends it to the table of pages at ``path``."""
    pages = sinks.read_or(requests.sparkSession.createDataFrame([], PAGE), path)
    fetch(due(requests, pages, as_of, hours), tasks, **ways).write.mode("append").parquet(path)


def latest(pages: DataFrame) -> DataFrame:
    """The last page without an error of each url (plain and rendered alike)."""
    rest = [c for c in pages.columns if c != "url"]
    return pages.filter(F.col("error").isNull()).groupBy("url").agg(F.max_by(F.struct(*rest), "fetched_at").alias("p")).select("url", "p.*")


def hasty(log: DataFrame, host: str, at: list[str], pause: float) -> DataFrame:
    """The rows of a crawl's log that came less than ``pause`` seconds after the one before from the same host, with ``waited`` (seconds). ``at``: a time, then what orders equal ones."""
    time_of = F.col(at[0]).cast("timestamp")
    before = F.lag(time_of).over(Window.partitionBy(host).orderBy(*at))
    return log.withColumn("waited", (F.unix_micros(time_of) - F.unix_micros(before)) / 1e6).filter(F.col("waited") < pause)
