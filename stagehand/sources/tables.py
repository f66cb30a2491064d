"""What pages list, as table functions: SQL calls the strategy of a venue by its name, with LATERAL.

    SELECT p.url, c.* FROM pages p, LATERAL stagehand_selectors(p.body, map('show_card', 'li', 'title', 'a'), p.url) c

``TABLES`` is the registry: a strategy's name and its function. Each declares its columns by ``analyze``, which also checks
the arguments when the query is analysed, and gives no row for a null page. Rows are those of the pandas functions of ``listings``, ``details`` and ``sections``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from stagehand.functions.markup import select, tree
from stagehand.sources.details import BOXES, _boxes
from stagehand.sources.listings import CARD, _card
from stagehand.sources.sections import STRIPS, _strips

NUMBER = T.StructField("pos", T.IntegerType())
# Spark sends these classes with what they name, so they name functions and not modules, whose own UDFs can't be sent.


def _checked(name: str, said: dict[str, AnalyzeArgument], wanted: dict[str, type]) -> None:
    """Raises where an argument isn't of the type that a table function takes; null goes anywhere."""
    for (argument, kind), given in zip(wanted.items(), said.values(), strict=True):
        if given.isTable or not isinstance(given.dataType, kind | T.NullType):
            raise ValueError(f"{name} takes {kind.__name__} as {argument}, not {'a table' if given.isTable else given.dataType.simpleString()}")


def _columns(inside: T.ArrayType, without: tuple[str, ...] = ()) -> T.StructType:
    return T.StructType([NUMBER, *(f for f in inside.elementType.fields if f.name not in without)])


class Cards:
    """Cards of a page by a venue's selectors; urls are resolved against ``base``."""

    @staticmethod
    def analyze(page: AnalyzeArgument, selectors: AnalyzeArgument, base: AnalyzeArgument) -> AnalyzeResult:
        _checked("selectors", {"page": page, "selectors": selectors, "base": base}, {"page": T.StringType, "selectors": T.MapType, "base": T.StringType})
        if isinstance(selectors.dataType, T.MapType) and not isinstance(selectors.dataType.valueType, T.StringType):
            raise ValueError("selectors are a map of texts")
        if selectors.isConstantExpression and selectors.value is not None and not selectors.value.get("show_card"):
            raise ValueError("selectors must name show_card")
        return AnalyzeResult(schema=_columns(CARD))

    def eval(self, page: str | None, selectors: dict[str, str] | None, base: str | None) -> Iterator[tuple]:
        if page is not None and (selectors or {}).get("show_card"):
            for pos, card in enumerate(select(tree(page), selectors["show_card"])):
                told = _card(card, selectors, base or "")
                yield (pos, *(told[f.name] for f in CARD.elementType.fields))


class Boxes:
    """Headings and short texts of a page, of up to ``longest`` characters, with the links of headings."""

    @staticmethod
    def analyze(page: AnalyzeArgument, longest: AnalyzeArgument | None = None) -> AnalyzeResult:
        said = {"page": page} | ({"longest": longest} if longest else {})
        _checked("dated_clusters", said, dict(list({"page": T.StringType, "longest": T.IntegerType}.items())[: len(said)]))
        return AnalyzeResult(schema=T.StructType(BOXES.elementType.fields))

    def eval(self, page: str | None, longest: int | None = None) -> Iterator[tuple]:
        for box in _boxes(page, longest or 80) if page is not None else ():
            yield tuple(box[f.name] for f in BOXES.elementType.fields)


class Strips:
    """Headings of sections and of shows, these with the lines and links of their strip."""

    @staticmethod
    def analyze(page: AnalyzeArgument) -> AnalyzeResult:
        _checked("immersive_rumours", {"page": page}, {"page": T.StringType})
        return AnalyzeResult(schema=_columns(STRIPS))

    def eval(self, page: str | None) -> Iterator[tuple]:
        for pos, strip in enumerate(_strips(page) if page is not None else ()):
            yield (pos, *(strip[f.name] for f in STRIPS.elementType.fields))


#: Strategies whose rows a page's tree gives.
TABLES = {"selectors": Cards, "dated_clusters": Boxes, "immersive_rumours": Strips}


def register(spark: SparkSession) -> dict[str, str]:
    """Makes SQL know the table functions; gives the name of each strategy's."""
    from pyspark.sql.functions import udtf

    named = {}
    for strategy, made in TABLES.items():
        named[strategy] = f"stagehand_{strategy}"
        spark.udtf.register(named[strategy], udtf(made))
    return named
