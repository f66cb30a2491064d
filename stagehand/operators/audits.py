"""Is the byline a hook, and does the description say more? Rules, coverage, and a look at the pages themselves."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stagehand.functions import markup
from stagehand.functions.columns import squeeze, strip
from stagehand.operators import quantiles, snapshots

NO_COPY = "no copy at all"
#: Patterns of the audit's rules.
CREDIT = r"(?i)^(?:by|written by|directed by|book by)\b"
BOOKING = r"(?i)\b(?:general sale|book(?:ing)? now|£\d|box office|running time|latecomers|on sale)\b"
LEAKED = r"(?i)cookie|newsletter|committed to ensuring|enable javascript|privacy policy"


def rules(byline: Column, description: Column, title: Column) -> list[tuple[str, Column]]:
    """(label, condition) over a byline, description and title; missing ones are empty."""
    b, d, t = (strip(F.coalesce(c, F.lit(""))) for c in (byline, description, title))
    has, more = b != "", d != ""
    return [
        (NO_COPY, ~has & ~more),
        ("byline but no description", has & ~more),
        ("byline is a credit, not a hook", b.rlike(CREDIT)),
        ("byline is booking chrome", b.rlike(BOOKING)),
        ("boilerplate leaked in", F.concat_ws(" ", b, d).rlike(LEAKED)),
        ("byline only restates the title", has & (F.lower(F.rtrim(b, F.lit("."))) == F.lower(t))),
        ("description just repeats the byline", has & more & F.startswith(d, b)),
        ("byline too short to sell anything", has & (F.length(b) < 25)),
    ]


def grade(events: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each rule that an event breaks; one without copy breaks nothing else."""
    return snapshots.audit(events, rules(F.col("byline"), F.col("description"), F.col("title")), keep, NO_COPY)


def coverage(events: DataFrame) -> DataFrame:
    """One row: events, venues, and of bylines and descriptions how many, what percent, median and longest."""
    out, middle = [F.count("*").alias("events"), F.count_distinct("venue_id").alias("venues")], []
    for name in ("byline", "description"):
        size = F.nullif(F.length(name), F.lit(0))
        out += [F.count(size).alias(f"{name}s"), F.floor(100 * F.count(size) / F.count("*")).alias(f"{name}_percent"), F.max(size).alias(f"{name}_most")]
        middle.append(quantiles.exact(events.select(size.alias("size")), [], "size").select(F.col("quantile").alias(f"{name}_median")))
    return events.agg(*out).crossJoin(middle[0]).crossJoin(middle[1])  # single rows


@F.pandas_udf(T.ArrayType(T.StringType()))
def page_paragraphs(pages: pd.Series) -> pd.Series:
    """The paragraphs of each page outside scripts, styles, menus, headers and footers."""
    def one(page):
        root = markup.tree(page or "")
        out, todo = [], [root]
        while todo:
            at = todo.pop()
            if at.tag == "p":
                out.append(at.text())
            todo.extend(n for n in reversed(at.inside) if isinstance(n, markup.Node) and n.tag not in ("script", "style", "nav", "footer", "header"))
        return out

    return pages.map(one)


def live(events: DataFrame, pages: DataFrame, least: int = 46, most: int = 4) -> DataFrame:
    """Events with ``said``, the first paragraphs of ``least`` characters of their pages; null if ``pages`` (url, body) has none."""
    told = pages.select("url", F.slice(F.filter(F.transform(page_paragraphs("body"), squeeze), lambda p: F.length(p) >= least), 1, most).alias("said"))
    return events.join(told, "url", "left")
