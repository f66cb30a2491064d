"""The weekly build: from listing rows to extract records, with what was dropped and why."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagehand.functions import text
from stagehand.functions.columns import filled
from stagehand.operators import windows
from stagehand.sources import details, listings

RECORD = ["venue_id", "title", "byline", "description", "first_date", "last_date", "url", "tags"]


def horizon(as_of: Column, weeks: Column) -> Column:
    """The last day of a window of ``weeks``."""
    return F.date_add(as_of, (7 * weeks).cast("int"))


def resolve_window(start: datetime.date | None, end: datetime.date | None, dumped: list[datetime.date] | None, as_of: datetime.date, weeks: int = 8) -> tuple[datetime.date, datetime.date]:
    """The window asked for, else that of the dump, else ``weeks`` from ``as_of``."""
    if start and end:
        return start, end
    return tuple(dumped) if dumped else (as_of, as_of + datetime.timedelta(weeks=weeks))


def select_ids(known: set[str], include: list[str], exclude: list[str]) -> list[str]:
    """The ids to read: those included, or all, without those excluded; an unknown id is an error."""
    unknown = sorted({*include, *exclude} - known)
    if unknown:
        raise ValueError(f"unknown venues: {', '.join(unknown)}")
    return sorted((set(include) or known) - set(exclude))


def in_reach(rows: DataFrame, venues: DataFrame, as_of: Column, weeks: int) -> DataFrame:
    """Rows that may fall in their venue's window; those without dates pass."""
    to = horizon(as_of, F.coalesce("lookahead_weeks", F.lit(weeks)))
    near = rows.join(venues.select(F.col("id").alias("venue_id"), to.alias("_to")), "venue_id", "left")
    end = F.coalesce("_to", horizon(as_of, F.lit(weeks)))
    return near.filter(windows.overlaps_or_unknown(F.col("first_date"), F.col("last_date"), as_of, end)).drop("_to")


def crawl(rows: DataFrame, venues: DataFrame, pages: DataFrame, as_of: Column, weeks: int = 8) -> DataFrame:
    """Listing rows (``listings.COLUMNS``) as shows: windowed, one a url, with their own pages folded in, merged into runs, their copy split into byline and description.

    The window comes before the pages, so that no page is read for a row that goes, and again
    after them, for dates that only pages tell.
    """
    near = in_reach(rows, venues, as_of, weeks).withColumn("_url", F.rtrim(F.coalesce("url", F.lit("")), F.lit("/")))
    once = windows.first_wins(near, ["venue_id", "_url"], ["pos"], F.col("_url") == "").drop("_url")
    priced = once.withColumns({"price_min": F.lit(None).cast("double"), "price_max": F.lit(None).cast("double")})
    full = details.hop(priced, venues, pages, as_of).withColumn("_key", text.title_key(F.col("title")))
    runs = windows.merge_runs(full, ["venue_id", "_key"], "pos", "first_date", "last_date", ["description"], ["price_min"], ["price_max"], empty=~filled(F.col("_key"))).drop("_key")
    cleaned = runs.withColumn("description", text.unescaped("description")).withColumn("_c", text.finalise_copy(F.col("description"), F.col("title")))
    return in_reach(cleaned.withColumns({"byline": F.col("_c.byline"), "description": F.col("_c.description")}).drop("_c"), venues, as_of, weeks)


def normalised(rows: DataFrame, start: datetime.date | None = None, end: datetime.date | None = None) -> DataFrame:
    """Rows with the fields of a record, ``reason`` (why a row is dropped, or null) and ``no_copy``; without a window only rows without dates are dropped.

    A row without a byline has its description split.
    """
    first, last = F.col("first_date"), F.col("last_date")
    reason = windows.drop_reason(first, last, F.lit(start), F.lit(end)) if start and end else F.when(first.isNull() | last.isNull(), "no parseable dates")
    bare = ~filled(F.col("byline"))
    out = rows.withColumn("_h", F.when(bare, text.split_hook(F.col("description"))))
    out = out.withColumns({"byline": F.when(bare, F.col("_h.byline")).otherwise(F.col("byline")), "description": F.when(bare, F.col("_h.description")).otherwise(F.col("description"))}).drop("_h")
    copy = F.concat_ws(" ", F.coalesce("byline", F.lit("")), F.coalesce("description", F.lit("")))
    tags = text.form_tags(F.col("title"), F.col("credits"), copy, F.col("venue_tags"))
    missing = ~filled(F.col("byline")) & ~filled(F.col("description"))
    return out.withColumns({"tags": tags, "reason": reason, "no_copy": reason.isNull() & missing})


def records(built: DataFrame) -> DataFrame:
    """The extract records of ``normalised`` rows, in the order of dates and venues."""
    return built.filter("reason is null").orderBy("first_date", "venue_id", "pos").select(*RECORD)


def dropped(built: DataFrame) -> DataFrame:
    """(``venue_id``, ``title``, ``reason``) of the rows left out."""
    return built.filter("reason is not null").select("venue_id", "title", "reason")


def without_copy(built: DataFrame) -> DataFrame:
    """(``venue_id``, ``title``) of the records without any copy."""
    return built.filter("no_copy").select("venue_id", "title")


def report(venues: DataFrame, rows: DataFrame, pages: DataFrame, shows: DataFrame, as_of: Column, weeks: int = 8) -> DataFrame:
    """(``venue_id``, ``shows``, ``hops``, ``status``) of every venue of a crawl: how many shows it gave, and how many pages of shows were wanted.

    ``pages`` (url, body, maybe error) tells why a listing failed; ``rows`` are the listings', ``shows`` what ``crawl`` made of them.
    """
    by, bare = listings.strategy(venues), ~filled(F.col("whats_on_url"))
    skipped = F.when(by == "skip", F.when(bare, "skipped: no whats_on_url (unverified)").otherwise("skipped: js_rendered, needs a strategy"))
    asked = F.when(by.isin("wp_rest", "sanity") & filled(F.col("endpoint")), F.col("endpoint")).otherwise(F.col("whats_on_url"))
    error = F.col("error") if "error" in pages.columns else F.lit(None).cast("string")
    told = pages.groupBy("url").agg(F.count("body").alias("_got"), F.min(error).alias("_error"))
    failed = F.when(F.coalesce("_got", F.lit(0)) == 0, F.concat(F.lit("stage1 failed: "), F.coalesce("_error", F.lit("not fetched"))))
    near = in_reach(rows, venues, as_of, weeks).withColumn("_url", F.rtrim(F.coalesce("url", F.lit("")), F.lit("/")))
    once = windows.first_wins(near, ["venue_id", "_url"], ["pos"], F.col("_url") == "")
    of = venues.select(F.col("id").alias("venue_id"), F.col("whats_on_url").alias("_on"), F.coalesce("skip_stage2", F.lit(False)).alias("_skip"))
    wanted = once.join(of, "venue_id").filter(~F.col("_skip") & details.wants_detail(F.col("url"), F.col("_on"), F.col("description"), F.col("first_date")))
    hops = wanted.groupBy("venue_id").agg(F.count("*").alias("hops"))
    n = shows.groupBy("venue_id").agg(F.count("*").alias("shows"))
    base = venues.select(F.col("id").alias("venue_id"), skipped.alias("_skipped"), asked.alias("url")).join(told, "url", "left")
    status = F.coalesce("_skipped", failed, F.lit("ok"))
    found = base.select("venue_id", status.alias("status")).join(n, "venue_id", "left").join(hops, "venue_id", "left")
    ok = F.col("status") == "ok"
    return found.select("venue_id", *[F.when(ok, F.coalesce(c, F.lit(0))).otherwise(0).cast("long").alias(c) for c in ("shows", "hops")], "status")


def crawl_order(rows: DataFrame) -> DataFrame:
    """By first date, rows without one last, then venue and place."""
    return rows.orderBy(F.col("first_date").asc_nulls_last(), "venue_id", "pos")
