"""Mixing sources to target weights by weighted fair queueing.

Each source's documents stand in a queue, shuffled by a hash and repeated up to
``epochs`` times. A copy's virtual finish time is the queue's words up to and with
it, divided by the source's target. All copies are taken in the order of that time
while their words fit the total budget.

Nothing wide is shuffled. The words of each document go, with a 60-bit order key,
through a sharded running total; one number, the time at which the budget is full,
comes out of a histogram of finish times and the rows of its last bin; it becomes,
for each source and repetition, the largest order key taken. Applying the mix to
documents is then a comparison with a table of one row per source.

Defined cases: a null text has no words; a null source is a source, after all
others; equal rows (same id and text) share a key and are taken together; a source
without words has the target 0 and nothing is taken; an empty table gives an empty
one. Columns of the input that clash with ``size``, ``source_size``, ``target``,
``taken`` or ``copies`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, n_words, order_key, running_total, shards_for

OUT = ("size", "source_size", "target", "taken", "copies")
SEED = "mix"


def _source_key(column: str):
    """A non-null string that orders sources by code point, null last."""
    return F.when(F.col(column).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(column).cast("string")))


def targets(sizes: DataFrame, weights: tuple[int, ...], epochs: int) -> DataFrame:
    """Adds ``target`` to (``_source``, ``source_size``): shares of the total by weight, at most ``epochs`` times the size.

    Sources are taken in the order of cap to weight. Each is capped as long as its
    ratio is at most the level that is left for those after it, which is what
    resharing the excess until none is above comes to. The table has a row per source.
    """
    everyone = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("_rank", F.row_number().over(everyone.orderBy("_source")) - 1)
    ranked = ranked.withColumn("_weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("_cap", F.col("source_size") * epochs).withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    before = everyone.orderBy("_ratio", "_rank").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everyone) - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / (F.sum("_weight").over(everyone) - F.coalesce(F.sum("_weight").over(before), F.lit(0)))
    ranked = ranked.withColumn("_level", level)
    ranked = ranked.withColumn("_free", F.min(F.when(F.col("_ratio") > F.col("_level"), F.struct("_ratio", "_rank", "_level"))).over(everyone))
    capped = F.col("_free").isNull() | (F.struct("_ratio", "_rank") < F.struct(F.col("_free._ratio"), F.col("_free._rank")))
    return ranked.select("_source", "source_size", F.when(capped, F.col("_cap").cast("double")).otherwise(F.col("_weight") * F.col("_free._level")).alias("target"))


def profile(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Id, source, words and order key of every document, written once."""
    return cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            _source_key(source_col).alias("_source"),
            n_words(F.col(text_col)).alias("size"),
            order_key(SEED, F.col(id_col), F.col(text_col)).alias("_key"),
        )
    )


def plan(profiled: DataFrame, weights: tuple[int, ...] = (5, 2, 1), epochs: int = 3) -> DataFrame:
    """A row per source: size, target and, for each repetition, the largest key taken (``_until``)."""
    rows = profiled.count()
    sizes = profiled.groupBy("_source").agg(F.sum("size").alias("source_size"))
    per_source = cut(targets(sizes, weights, epochs))
    budget = per_source.agg(F.sum("source_size")).first()[0] or 0
    queued = running_total(profiled.filter("size > 0"), "_source", "_key", F.col("size"), shards_for(rows), "_cum", peers=True)
    queued = cut(queued.select("_source", "_key", "size", "_cum"))
    # A row per source: never large; above the broadcast limit it is an ordinary join.
    timed = queued.join(per_source, "_source").select(
        "_source", "_key", "size", F.explode(F.transform(F.sequence(F.lit(0), F.lit(epochs - 1)), lambda e: F.struct(e.alias("epoch"), ((e * F.col("source_size") + F.col("_cum")) / F.col("target")).alias("time")))).alias("_c")
    ).select("_source", "_key", "size", "_c.*")
    bins = 256 + rows // 10_000
    timed = timed.withColumn("_bin", F.floor(F.col("time") * bins))
    summed = timed.groupBy("_bin").agg(F.sum("size").alias("_words")).withColumn("_upto", F.sum("_words").over(Window.partitionBy(F.lit(0)).orderBy("_bin")))
    last = summed.filter(F.col("_upto") > budget).orderBy("_bin").first()
    if last is None:
        until = F.lit(True)
    else:
        inside = timed.filter(F.col("_bin") == last["_bin"]).groupBy("time").agg(F.sum("size").alias("_words"))
        inside = inside.withColumn("_upto", F.sum("_words").over(Window.partitionBy(F.lit(0)).orderBy("time")) + F.lit(last["_upto"] - last["_words"]))
        end = inside.filter(F.col("_upto") <= budget).agg(F.max("time")).first()[0]
        until = F.col("_bin") < last["_bin"] if end is None else F.col("time") <= F.lit(end)
    taken = timed.filter(until).groupBy("_source").pivot("epoch", list(range(epochs))).agg(F.max("_key"))
    taken = taken.select("_source", F.array(*[F.col(str(e)) for e in range(epochs)]).alias("_until"))
    return cut(per_source.join(taken, "_source", "left"))


def apply_plan(keyed: DataFrame, planned: DataFrame) -> DataFrame:
    """Adds ``source_size``, ``target`` and ``copies`` to rows with ``_source`` and ``_key``."""
    copies = F.coalesce(F.aggregate("_until", F.lit(0), lambda n, k: n + F.when(F.col("_key") <= k, 1).otherwise(0)), F.lit(0))
    return keyed.join(planned, "_source").withColumn("copies", copies.cast("int")).drop("_until")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), epochs: int = 3) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``copies`` (0 to ``epochs``) and ``taken`` (words: copies times size)."""
    docs = docs.drop(*OUT)
    planned = plan(profile(docs, id_col, text_col, source_col), weights, epochs)
    keyed = docs.withColumns({"_source": _source_key(source_col), "_key": order_key(SEED, F.col(id_col), F.col(text_col)), "size": n_words(F.col(text_col))})
    return apply_plan(keyed, planned).withColumn("taken", F.col("size") * F.col("copies")).drop("_source", "_key")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as many times as it is taken, in the columns of ``docs``."""
    columns = docs.columns
    mixed = mix(docs, **options).filter("copies > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*columns)
