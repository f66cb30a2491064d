"""Free-text date ranges, as Columns. ``as_of`` takes the place of today."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stagehand.functions.columns import let

MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
MONTH = "(?:january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sept|sep|oct|nov|dec)"


def _month(name: Column) -> Column:
    return F.nullif(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.substring(F.lower(name), 1, 3)), F.lit(0)).cast("int")


def _date(year: Column, month: Column, day: Column) -> Column:
    return F.concat(year.cast("string"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(day.cast("string"), 2, "0")).try_cast("date")


def parse_range(text: Column, as_of: Column, default_year: Column | None = None) -> Column:
    """A struct (first_date, last_date), both null if no range is found.

    The start takes the first year named, the end the last; an end before the start moves a
    year on if both years are equal. Days without a month take the last month named; numbers of a text that
    names no day of a month are no days. A month alone counts with a year or after "until" and is all of it; after "until" the start is ``as_of``, or the end if that is past.
    """
    lower = F.lower(F.coalesce(text, F.lit("")))
    years = F.regexp_extract_all(lower, F.lit(r"\b(20\d\d)\b"), F.lit(1))
    base = F.coalesce(default_year, F.year(as_of)) if default_year is not None else F.year(as_of)
    first_year = F.coalesce(F.get(years, 0).cast("int"), base)
    last_year = F.coalesce(F.get(years, F.size(years) - 1).cast("int"), base)
    plain = lower
    for pattern, by in ((r"\b20\d\d\b", " "), (r"(?<=\d)(?:st|nd|rd|th)\b", ""), (rf"\b({MONTH})\.", "$1"), (r"\b(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:days?)?\b", " "), (r"\bat\b.*", " "), (r"\b\d{1,2}[:.]\d\d\s*(?:[ap]m)?\b", " "), (r"\b\d{1,2}\s*[ap]m\b", " ")):
        plain = F.regexp_replace(plain, pattern, by)
    shape = lambda ps: F.filter(F.transform(ps, lambda p: F.struct(p["d"].cast("int").alias("d"), _month(F.nullif(p["m"], F.lit(""))).alias("m"))), lambda p: p["d"].between(1, 31))
    day_first, month_first = rf"(\d{{1,2}})(?:\s*({MONTH})(?![a-z]))?", rf"({MONTH})\s+(\d{{1,2}})"

    def pairs(plain: Column, pattern: str, d: int, m: int) -> Column:
        found = lambda group: F.regexp_extract_all(plain, F.lit(pattern), F.lit(group))
        return shape(F.zip_with(found(d), found(m), lambda x, y: F.struct(x.alias("d"), y.alias("m"))))

    def read(plain: Column) -> Column:
        named = F.coalesce(F.nullif(F.regexp_extract(lower, rf"\buntil\s+({MONTH})\b", 1), F.lit("")), F.nullif(F.regexp_extract(lower, rf"\b({MONTH})\s+20\d\d\b", 1), F.lit("")))
        lone = _month(named)
        forward, turned = pairs(plain, day_first, 1, 2), pairs(plain, month_first, 2, 1)
        choose = lambda v: F.when(F.exists(v["f"], lambda p: p["m"].isNotNull()), v["f"]).otherwise(v["t"])
        used = let(F.struct(forward.alias("f"), turned.alias("t")), choose)
        return let(F.struct(used.alias("used"), lone.alias("lone"), first_year.alias("y1"), last_year.alias("y2")), dated)

    def dated(v: Column) -> Column:
        used = v["used"]
        months = F.filter(F.transform(used, lambda p: p["m"]), lambda m: m.isNotNull())
        fill = F.get(months, F.size(months) - 1)
        start_at, end_at = F.get(used, 0), F.get(used, F.size(used) - 1)
        ends = lambda year: _date(year, F.coalesce(end_at["m"], fill), end_at["d"])
        some = F.struct(
            F.when(F.size(used) > 0, _date(v["y1"], F.coalesce(start_at["m"], fill), start_at["d"])).otherwise(_date(v["y2"], v["lone"], F.lit(1))).alias("a"),
            F.when(F.size(used) > 0, ends(v["y2"])).otherwise(F.last_day(_date(v["y2"], v["lone"], F.lit(1)))).alias("b"),
            ends(v["y2"] + 1).alias("c"), (v["y1"] == v["y2"]).alias("same"),
        )
        return let(some, lambda d: F.struct(d["a"].alias("a"), F.when((d["b"] < d["a"]) & d["same"], d["c"]).otherwise(d["b"]).alias("b")))

    def finish(d: Column) -> Column:
        first = F.when(lower.rlike(r"\buntil\b"), F.least(as_of, d["b"])).otherwise(d["a"])
        good = d["a"].isNotNull() & d["b"].isNotNull()
        return F.struct(F.when(good, first).alias("first_date"), F.when(good, d["b"]).alias("last_date"))

    return let(let(plain, read), finish)


def iso_day(text: Column) -> Column:
    """The date of an ISO timestamp's first ten characters, or null."""
    return F.substring(text, 1, 10).try_cast("date")


def date_span(as_of: Column, latest: Column) -> Column:
    """The later of the last day of the month two months ahead and ``latest``."""
    return F.greatest(F.last_day(F.add_months(as_of, 2)), latest)
