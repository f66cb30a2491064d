"""Listings in sections, one show a strip of its page, with fields marked by emoji."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stagehand.functions import markup
from stagehand.functions.columns import let
from stagehand.functions.dates import parse_range

#: Section headings by a part of their text, the first that fits; marks of fields; openings of lines that tell nothing of the show.
SECTIONS = (("at home", "home"), ("outside of london", "outside"), *((k, "london") for k in ("immersive/interactive", "dining", "cocktail", "vr and", "coming soon")))
PLACE, DATES = "\U0001f4cd", "\U0001f552"
MARKED = (PLACE, "\U0001f4b0", DATES, "\U0001f39f\ufe0f", "\u2605")
IDLE = r"(?i)^(?:click to read|save \d|interview:|jump to)"
AT_HOME = ("at home", "whatsapp", "online")
OWN_HOSTS = ("immersiverumours.com", "wix.com")
OPEN_DAYS = 400

STRIPS = T.ArrayType(T.StructType([T.StructField("tag", T.StringType()), T.StructField("heading", T.StringType()), T.StructField("lines", T.ArrayType(T.StringType())), T.StructField("links", T.ArrayType(T.StringType()))]))


def _lines(node: markup.Node) -> list[str]:
    """The pieces of text inside, one a line."""
    out, todo = [], list(reversed(node.inside))
    while todo:
        at = todo.pop()
        if isinstance(at, str):
            out.append(at.strip())
        elif at.tag not in markup.SILENT:
            todo.extend(reversed(at.inside))
    return "\n".join(x for x in out if x).split("\n")


def _strips(page: str | None, climb: int = 10) -> list[dict]:
    out = []
    for n in markup.tree(page or "").below():
        if n.tag not in ("h2", "h6") or not n.text():
            continue
        at: markup.Node | None = n
        for _ in range(climb):
            if at is None or (at.tag == "section" and "column-strip" in at.attrs.get("class", "")):
                break
            at = at.parent
        inside = n.tag == "h2" and at is not None
        links = [x.attrs["href"] for x in at.below() if x.tag == "a" and x.attrs.get("href")] if inside else []
        if n.tag == "h6" or inside:
            out.append({"tag": n.tag, "heading": n.text(), "lines": _lines(at) if inside else [], "links": links})
    return out


@F.pandas_udf(STRIPS)
def strips(pages: pd.Series) -> pd.Series:
    """Headings of sections (h6) and of shows (h2), these with the lines and links of their strip."""
    return pages.map(_strips)


def _field(lines: Column, mark: str) -> Column:
    """What follows a mark on the first line that has it."""
    found = F.get(F.filter(lines, lambda x: x.contains(mark)), 0)
    return F.trim(F.regexp_extract(found, f"{mark}\\s*(.+)", 1))


def _section(heading: Column) -> Column:
    low = F.lower(heading)
    return F.coalesce(*[F.when(low.contains(part), F.lit(name)) for part, name in SECTIONS])


def _run(dates: Column, as_of: Column) -> Column:
    """(first_date, last_date): open runs end ``OPEN_DAYS`` after their start, a late summer is August and September."""
    year = F.coalesce(F.nullif(F.regexp_extract(dates, r"(20\d{2})", 1), F.lit("")).cast("int"), F.year(as_of))
    pair = lambda a, b: F.struct(a.alias("first_date"), b.alias("last_date"))

    def read(w: Column) -> Column:
        lone = dates.rlike(r"(?i)\bfrom\b") & (w["first_date"] == w["last_date"])
        return (
            F.when(dates.rlike(r"(?i)\bongoing\b"), pair(as_of, F.date_add(as_of, OPEN_DAYS)))
            .when(dates.rlike(r"(?i)late summer"), pair(F.make_date(year, F.lit(8), F.lit(1)), F.make_date(year, F.lit(9), F.lit(30))))
            .when(lone, pair(w["first_date"], F.date_add(w["first_date"], OPEN_DAYS)))
            .otherwise(pair(w["first_date"], w["last_date"]))
        )

    return let(parse_range(dates, as_of), read)


def sections(venues: DataFrame, pages: DataFrame, as_of: Column, most: int = 5) -> DataFrame:
    """Rows of shows under the last section heading before them; those outside go, those at home have the venue "home".

    The copy is up to ``most`` lines of a strip that are neither the heading, a marked field nor idle.
    """
    at = venues.select(F.col("id").alias("venue_id"), "whats_on_url").join(pages.select("url", "body"), F.col("whats_on_url") == F.col("url"))
    rows = at.select("venue_id", "whats_on_url", F.posexplode(strips("body")).alias("pos", "n")).select("venue_id", "whats_on_url", "pos", "n.*")
    before = Window.partitionBy("venue_id", "whats_on_url").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("section", F.coalesce(F.last(F.when(F.col("tag") == "h6", _section(F.col("heading"))), ignorenulls=True).over(before), F.lit("london")))
    rows = rows.filter((F.col("tag") == "h2") & (F.col("section") != "outside"))
    place, dates = F.lower(F.coalesce(_field(F.col("lines"), PLACE), F.lit(""))), F.coalesce(_field(F.col("lines"), DATES), F.lit(""))
    rows = rows.select("*", dates.alias("dates"), ((F.col("section") == "home") | place.isin(*AT_HOME)).alias("home")).withColumn("w", _run(F.col("dates"), as_of))
    link = F.get(F.filter("links", lambda h: h.startswith("http") & ~h.contains(OWN_HOSTS[0]) & ~h.contains(OWN_HOSTS[1])), 0)
    marked = lambda x: F.exists(F.array(*[F.lit(m) for m in MARKED]), lambda m: F.startswith(x, m))
    heading = F.col("heading")
    copy = F.filter(F.transform("lines", lambda x: F.trim(x)), lambda x: (x != "") & (x != heading) & ~marked(x) & ~x.rlike(IDLE))
    return rows.select(
        F.when(F.col("home"), "home").otherwise(F.col("venue_id")).alias("venue_id"), F.col("pos").cast("long").alias("pos"), heading.alias("title"),
        F.lit(None).cast("string").alias("credits"), F.coalesce(link, "whats_on_url").alias("url"), "w.first_date", "w.last_date",
        F.nullif(F.array_join(F.slice(copy, 1, most), "\n\n"), F.lit("")).alias("description"), F.array(F.lit("immersive")).alias("venue_tags"), F.lit("immersive_rumours").alias("source"),
    )
