"""Small helpers for building Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once and named, so that the expression doesn't grow with its uses."""
    return F.get(F.transform(F.array(value), body), 0)


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def stripped(text: Column) -> Column:
    """``strip`` of a named value, which looks at both ends first."""
    return F.when(F.concat(F.left(text, F.lit(1)), F.right(text, F.lit(1))).rlike(r"(?U)\s"), strip(text)).otherwise(text)


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def filled(text: Column) -> Column:
    """True for texts that are neither null nor empty."""
    return F.coalesce(text != "", F.lit(False))
