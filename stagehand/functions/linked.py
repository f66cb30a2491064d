"""Linked data (JSON-LD) of pages as VARIANT trees, walked level by level in the JVM by a recursive query.

A page's blocks are parsed by ``try_parse_json`` (a block that isn't JSON, or names a key twice, counts as empty) and every object and array inside
is a row of the walk, whatever its depth. Typed objects come in the order in which a stack gives them: a block's before the next one's, an object before
what is in it, and of what an object or array holds the last first. A VARIANT keeps the keys of an object in alphabetical order, so that is the order of
values in one object; items of an array keep theirs.

Pages are told apart by a digest of their body, so equal bodies are walked once, and pages without linked data aren't walked at all.
``nodes`` takes the same walk within a page's row, where bodies needn't be shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagehand.functions.columns import let

SCRIPT = r"""(?is)<script[^>]*type\s*=\s*["']?application/ld\+json["']?[^>]*>(.*?)</script>"""
NODE = "type string, title string, url string, start string, end string, description string, price string, keys array<string>"
WALK = """
WITH RECURSIVE walk(key, path, v) AS (
  SELECT key, array(block), try_parse_json(text) FROM {blocks}
  UNION ALL
  SELECT w.key, array_append(w.path, -c.pos), c.value FROM walk w, LATERAL variant_explode(w.v) c
  WHERE try_variant_get(c.value, '$', 'map<string,variant>') IS NOT NULL OR try_variant_get(c.value, '$', 'array<variant>') IS NOT NULL)
SELECT key, path, v FROM walk WHERE try_variant_get(v, '$["@type"]', 'variant') IS NOT NULL"""


def blocks(body: Column) -> Column:
    """The texts of a page's blocks."""
    return F.coalesce(F.regexp_extract_all(body, F.lit(SCRIPT), F.lit(1)), F.array().cast("array<string>"))


def _said(v: Column, name: str) -> Column:
    """A field that is a text, else null."""
    field = F.try_variant_get(v, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(field) == "STRING", F.try_variant_get(v, f"$.{name}", "string"))


def _type(v: Column) -> Column:
    """The types of an object, joined by commas; null if it names none."""
    many = F.array_join(F.try_variant_get(v, '$["@type"]', "array<string>"), ",")
    return F.nullif(F.coalesce(many, F.try_variant_get(v, '$["@type"]', "string"), F.to_json(F.try_variant_get(v, '$["@type"]', "variant"))), F.lit(""))


def _told(v: Column, *wanted: str) -> list[Column]:
    """The fields of ``NODE`` of an object, or the ``wanted`` ones."""
    price = F.nullif(F.try_variant_get(v, "$.offers.price", "string"), F.lit(""))
    told = {"type": _type(v)} | {a: _said(v, n) for n, a in (("name", "title"), ("url", "url"), ("startDate", "start"), ("endDate", "end"), ("description", "description"))}
    told |= {"price": F.when(~F.coalesce(price.try_cast("double") == 0, F.lit(False)), price), "keys": F.array_sort(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")))}
    return [told[f].alias(f) for f in wanted or told]


def objects(pages: DataFrame, key: str, body: str) -> DataFrame:
    """(``key``, ``path``, ``NODE``) of every typed object of pages with distinct keys; ``path`` gives their order."""
    spark = pages.sparkSession
    # The defaults stop a query of a million rows or a hundred levels.
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    spark.conf.set("spark.sql.cteRecursionLevelLimit", "-1")
    texts = pages.select(F.col(key).alias("key"), F.posexplode(blocks(F.col(body))).alias("block", "text")).withColumn("text", F.trim("text"))
    found = spark.sql(WALK, blocks=texts)
    told = found.select(F.col("key").alias(key), "path", *_told(F.col("v")))
    return told.filter(F.col("type").isNotNull())


def with_objects(rows: DataFrame, body: str, nodes: str = "_nodes", count: str = "_blocks") -> DataFrame:
    """Adds the typed objects of each row's page, in order, and how many blocks it has (null for no page)."""
    marked = rows.withColumn("_digest", F.sha2(F.col(body), 256))
    some = marked.filter(F.col(body).rlike("(?i)application/ld\\+json")).select("_digest", body).dropDuplicates(["_digest"])
    fields = [c.split()[0] for c in NODE.split(", ")]
    found = objects(some, "_digest", body).groupBy("_digest").agg(F.array_sort(F.collect_list(F.struct("path", *fields))).alias("_all"))
    empty = F.array().cast(f"array<struct<{NODE.replace(' ', ':').replace(',:', ',')}>>")
    listed = F.coalesce(F.transform("_all", lambda n: F.struct(*[n[f].alias(f) for f in fields])), empty)
    joined = marked.join(found, "_digest", "left")
    return joined.select(*rows.columns, listed.alias(nodes), F.when(F.col(body).isNotNull(), F.size(blocks(F.col(body)))).alias(count))


TREES = "array<struct<path:array<int>,v:variant>>"


def nodes(body: Column, *wanted: str) -> Column:
    """The typed objects of a page in order, as ``with_objects`` lists them, or only the ``wanted`` fields of them, ``type`` first.

    A level is taken in one step, and there are no more levels than brackets that open. A block that can name a type but once,
    and does so for the whole, isn't walked; nor are pages that don't name the form of linked data searched for blocks.
    """
    as_object = lambda v: F.try_variant_get(v, "$", "map<string,variant>")
    as_array = lambda v: F.try_variant_get(v, "$", "array<variant>")
    is_typed = lambda n: F.try_variant_get(n["v"], '$["@type"]', "variant").isNotNull()
    none = F.array().cast(TREES)

    def inside(n: Column) -> Column:
        held = F.coalesce(F.map_values(as_object(n["v"])), as_array(n["v"]), F.array().cast("array<variant>"))
        placed = F.transform(held, lambda v, i: F.struct(F.concat(n["path"], F.array(-i)).alias("path"), v.alias("v")))
        return F.filter(placed, lambda m: as_object(m["v"]).isNotNull() | as_array(m["v"]).isNotNull())

    def level(at: Column, _: Column) -> Column:
        deeper = F.struct(F.concat(at["done"], at["todo"]).alias("done"), F.flatten(F.transform(at["todo"], inside)).alias("todo"))
        return F.when(F.size(at["todo"]) == 0, at).otherwise(deeper)

    def walked(text: Column, root: Column) -> Column:
        start = F.struct(none.alias("done"), F.array(root).cast(TREES).alias("todo"))
        every = F.aggregate(F.sequence(F.lit(0), F.regexp_count(text, F.lit(r"[\[{]"))), start, level, lambda at: at["done"])
        return F.when(is_typed(root) & (F.regexp_count(text, F.lit(r"@type|\\u")) == 1), F.array(root).cast(TREES)).otherwise(F.filter(every, is_typed))

    def block(text: Column, i: Column) -> Column:
        return let(F.struct(F.array(i).alias("path"), F.try_parse_json(F.trim(text)).alias("v")), lambda root: walked(text, root))

    texts = F.when(F.contains(F.lower(body), F.lit("ld+json")), blocks(body))
    told = F.transform(F.flatten(F.transform(texts, block)), lambda n: F.struct(n["path"].alias("path"), *_told(n["v"], *wanted)))
    fields = wanted or [c.split()[0] for c in NODE.split(", ")]
    listed = F.transform(F.array_sort(F.filter(told, lambda n: n["type"].isNotNull())), lambda n: F.struct(*[n[f].alias(f) for f in fields]))
    kinds = dict(c.split() for c in NODE.split(", "))
    return F.coalesce(listed, F.array().cast(f"array<struct<{','.join(f'{f}:{kinds[f]}' for f in fields)}>>"))


def events(nodes: Column) -> Column:
    """The objects of a type that names an Event."""
    return F.filter(nodes, lambda n: n["type"].contains("Event"))


def type_counts(nodes: Column) -> Column:
    """(type, n) of every type named by the objects, by type."""
    types = F.flatten(F.transform(nodes, lambda n: F.split(n["type"], ",")))
    return F.transform(F.array_sort(F.array_distinct(types)), lambda t: F.struct(t.alias("type"), F.size(F.filter(types, lambda x: x == t)).alias("n")))
