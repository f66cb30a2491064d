"""Personal data: exact patterns, and sanitisation by corpus co-occurrence.

Base spans are e-mail addresses, IPv4 addresses, card and phone numbers, each found
leftmost and without overlap within its kind, then validated (parts, Luhn, digits).

The values found are the protected entities. Terms (runs of letters and digits, lower
case) within ``window`` terms of a mention, on either side and outside base spans, are
candidates. Over all distinct texts, n(e) hold the entity, n(t) the term, n(t, e) both with
the term near. What the entity still tells once the term is seen is its information content
less the pointwise mutual information, log2 N / n(e) - log2 n(t, e) N / (n(t) n(e)), which
is log2 n(t) / n(t, e). One more text with the term alone is always assumed, so one sighting
is weak evidence and three are strong, and copies of one text are none: a term leaves
log2 (n(t) + 1) / n(t, e) bits. A term seen near the entity in fewer than ``sightings`` distinct texts
tells nothing of it, as every rare word of a single text would. At ``remove_bits`` or fewer it discloses the entity and is
removed; at ``generalise_bits`` or fewer it is generalised to the longest of its prefixes
of ``LEVELS`` characters that leaves more bits, counted alike over the surroundings of all
mentions (a lower bound of all texts), and removed if none does. A term is treated alike at
every place in every text, near a mention or not, outside base spans: by its strongest
finding.

Everything is in DataFrame functions. Spans are found once; they and the replacements of
the terms in a text go to its rows by the text's digest, in one shuffle of the texts. Matches
are placed by summing the lengths of the pieces between them. The patterns are possessive
where nothing can follow, so long runs need no stack, and start only at the end of a
match or outside their first class, so that long runs are read once.

Defined cases: a null text is an empty one; rows of null id are ordinary; repeated rows
get equal spans; an empty table gives an empty one; more input columns are ignored by
``report`` and kept by ``sanitise``; names that start with ``_pii_`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, swept

KINDS = ("email", "ip", "card", "phone")
EXTRA = ("removed", "generalised")
#: Fixed patterns, as run: possessive forms of the contract's.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried; all but the first are parts of the pattern.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
TERM, APART = r"[\p{L}\p{N}]+", r"[^\p{L}\p{N}]+"
#: Up to ``window`` terms at the start of a text.
OPENING = r"^(?:[^\p{L}\p{N}]*+[\p{L}\p{N}]++){0,%d}+"
LEVELS = (3, 1)
MASK = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
OUT = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
SPANS = "array<struct<start:int,ord:int,end:int>>"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _found(text: Column, pattern: str | Column) -> Column:
    """Matches as an array of (start, end, value), in code points, end exclusive."""
    pattern = F.lit(pattern)
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)").alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.length(pair["value"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), pair["value"].alias("value")))).alias("out"))

    def placed(values: Column) -> Column:
        pairs = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(values)), values, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
        return F.aggregate(pairs, zero, step, lambda acc: acc["out"])

    return _let(F.regexp_extract_all(text, pattern, F.lit(0)), placed)


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substr(turned, i, F.lit(1)).cast("int")
        twice = d * 2
        return acc + F.when(i % 2 == 1, d).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


EMPTY = "cast(array() as array<struct<start:int,ord:int,end:int,value:string>>)"


def base_spans(text: Column) -> Column:
    """All base spans of a non-null text: (start, ord, end, value), by start, then kind."""
    return F.array_sort(F.concat(*[_kind_spans(text, i, kind) for i, kind in enumerate(KINDS)]))


def _kind_spans(text: Column, place: int, kind: str) -> Column:
    hint = text.contains(HINTS[kind]) if kind == "email" else text.rlike(HINTS[kind])
    good = F.filter(_found(text, PATTERNS[kind]), lambda m: _valid(kind, m["value"]))
    shaped = F.transform(good, lambda m: F.struct(m["start"].alias("start"), F.lit(place).alias("ord"), m["end"].alias("end"), m["value"].alias("value")))
    return F.when(hint, shaped).otherwise(F.expr(EMPTY))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of spans with (start, ord, end), comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS + EXTRA])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["ord"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _outside(spans: Column, base: Column) -> Column:
    """Those of ``spans`` that no base span overlaps."""
    return F.filter(spans, lambda t: ~F.exists(base, lambda o: (o["start"] < t["end"]) & (t["start"] < o["end"])))


def _near(text: Column, span: Column, window: int) -> Column:
    """The ``window`` terms on either side of a span, as (start, end, term); a run of letters and digits that the span cuts is none."""
    run = r"[\p{L}\p{N}]"
    terms = lambda piece, shift: F.transform(_found(piece, TERM), lambda m: F.struct((m["start"] + shift).alias("start"), (m["end"] + shift).alias("end"), F.lower(m["value"]).alias("term")))

    def opening(side: Column, cuts: Column, use) -> Column:
        skip = lambda s: F.struct(s.alias("s"), F.when(cuts, F.length(F.regexp_extract(s, f"^{run}*+", 0))).otherwise(0).alias("k"))
        piece = lambda v: F.struct(v["k"].alias("k"), F.regexp_extract(F.substr(v["s"], v["k"] + 1), OPENING % window, 0).alias("p"))
        return _let(_let(_let(side, skip), piece), use)

    def before(v: Column) -> Column:
        return _let(span["start"] - v["k"] - F.length(v["p"]), lambda shift: terms(F.reverse(v["p"]), shift))

    left = opening(F.reverse(F.substr(text, F.lit(1), span["start"])), span["value"].rlike(f"^{run}"), before)
    right = opening(F.substr(text, span["end"] + 1), span["value"].rlike(f"{run}$"), lambda v: terms(v["p"], span["end"] + v["k"]))
    return F.concat(left, right)


def find(docs: DataFrame, text_col: str = "text", window: int = 8) -> DataFrame:
    """(``digest``, ``base``, ``mentions``, ``terms``) of every distinct text with base spans, written once.

    A mention is its entity and the terms near it; ``terms`` are all of the text's.
    """
    rows = docs.select(F.col(text_col).alias("text")).filter(F.length("text") > 0).withColumn("base", base_spans(F.col("text"))).filter(F.size("base") > 0)
    mention = F.transform("base", lambda s: F.struct(
        F.md5(F.concat(s["ord"].cast("string"), F.lit(":"), F.lower(s["value"]))).alias("entity"),
        F.transform(_outside(_near(F.col("text"), s, window), F.col("base")), lambda t: t["term"]).alias("near"),
    ))
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["end"].alias("end")))
    terms = F.array_distinct(F.transform(F.split("text", APART), F.lower))
    return cut(rows.select(F.md5("text").alias("digest"), base.alias("base"), mention.alias("mentions"), terms.alias("terms")).dropDuplicates(["digest"]))


def _prefix(term: Column, level: Column | int) -> Column:
    return F.substr(term, F.lit(1), F.lit(level) if isinstance(level, int) else level)


def disclosing(docs: DataFrame, found: DataFrame, text_col: str = "text", remove_bits: float = 0.5, generalise_bits: float = 1.0, sightings: int = 2) -> DataFrame:
    """(``digest``, ``terms``): for each text with disclosing terms, those terms and what stands in for them ('': nothing)."""
    most = max(remove_bits, generalise_bits)
    bits = lambda t, te: F.log2((F.col(t) + 1) / F.col(te))
    seen = cut(found.select("digest", F.explode("mentions").alias("m")).select("digest", "m.entity", F.explode(F.array_distinct("m.near")).alias("term")).distinct())
    pairs = seen.groupBy("entity", "term").agg(F.count("*").alias("n_te")).filter(F.col("n_te") >= sightings)
    # The texts with a term and any mention are no more than all its texts: a pair that fails by them fails by all.
    around = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("least"))
    pairs = cut(pairs.join(around, "term").filter(bits("least", "n_te") <= most).select("entity", "term", "n_te"))
    terms = pairs.select("term").distinct()
    words = docs.filter(F.length(text_col) > 0).select(F.md5(text_col).alias("digest"), F.explode(F.array_distinct(F.split(text_col, APART))).alias("term")).withColumn("term", F.lower("term"))
    few = terms.count()
    # Up to a million terms of a mention's surroundings are some tens of MB; more join by shuffle.
    places = cut(words.join(F.broadcast(terms) if few <= 1_000_000 else terms, "term").distinct()) if few else words.limit(0)
    counts = places.groupBy("term").agg(F.count("*").alias("n_t"))
    flagged = cut(pairs.join(counts, "term").withColumn("left", bits("n_t", "n_te")).filter(F.col("left") <= most).select("entity", "term", "left"))
    instead = _instead(flagged, seen, remove_bits, generalise_bits)
    hits = places.join(instead, "term").select("digest", "term", "instead")
    return hits.groupBy("digest").agg(F.map_from_entries(F.collect_list(F.struct("term", "instead"))).alias("terms"))


def _instead(flagged: DataFrame, seen: DataFrame, remove_bits: float, generalise_bits: float) -> DataFrame:
    """(``term``, ``instead``): its longest prefix that discloses none of its entities, with a star, or '' if all do or the term must go."""
    level = F.explode(F.array(*[F.lit(x) for x in LEVELS]))
    # Only prefixes of flagged terms are counted.
    wanted = flagged.filter(F.col("left") > remove_bits).select("entity", "term", level.alias("level")).filter(F.length("term") > F.col("level")).withColumn("class", _prefix(F.col("term"), F.col("level")))
    classes = seen.select("digest", "entity", "term", level.alias("level")).withColumn("class", _prefix(F.col("term"), F.col("level"))).select("digest", "entity", "level", "class").distinct()
    alone = classes.groupBy("entity", "level", "class").agg(F.count("*").alias("n_ce"))
    around = classes.select("digest", "level", "class").distinct().groupBy("level", "class").agg(F.count("*").alias("n_c"))
    safe = wanted.join(alone, ["entity", "level", "class"]).join(around, ["level", "class"]).groupBy("term", "level", "class").agg(F.min(F.log2((F.col("n_c") + 1) / F.col("n_ce"))).alias("left"))
    best = safe.filter(F.col("left") > generalise_bits).groupBy("term").agg(F.max_by("class", "level").alias("class"))
    strongest = flagged.groupBy("term").agg(F.min("left").alias("left"))
    covered = F.when(F.col("left") > remove_bits, F.concat(F.lit("["), "class", F.lit("*]")))
    return strongest.join(best, "term", "left").select("term", F.coalesce(covered, F.lit("")).alias("instead"))


def _terms(text: Column, base: Column, terms: Column) -> Column:
    """(start, ord, end, instead) of all places of ``terms`` outside base spans."""
    shaped = lambda t, instead: F.struct(t["start"].alias("start"), F.when(instead == "", len(KINDS)).otherwise(len(KINDS) + 1).alias("ord"), t["end"].alias("end"), instead.alias("instead"))
    spans = lambda pattern: F.transform(_outside(_found(text, pattern), base), lambda t: shaped(t, F.element_at(terms, F.lower(t["value"]))))
    # Letters and digits only, so nothing needs quoting.
    pattern = lambda words: F.when(F.size(words) > 0, F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(words, "|"), F.lit(r")(?![\p{L}\p{N}])")))
    words = F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), lambda w: F.map_contains_key(terms, F.lower(w))))
    return _let(_let(words, pattern), lambda p: F.when(p.isNotNull(), spans(p)))


def _marked(docs: DataFrame, text_col: str, window: int, **thresholds: float) -> DataFrame:
    """``docs`` with ``_pii_base`` and ``_pii_every``: base spans, and all spans with what stands in for them."""
    with swept(docs.sparkSession) as keep:
        found = find(docs, text_col, window)
        hits = disclosing(docs, found, text_col, **thresholds)
        marks = cut(found.select("digest", "base").join(hits, "digest", "full_outer").select(F.col("digest").alias("_pii_digest"), F.col("base").alias("_pii_base"), F.col("terms").alias("_pii_terms")))
        keep.append(marks)
    text, none = F.col(text_col), F.expr(f"cast(array() as {SPANS})")
    # The same join at every size: what is found grows with the input, so it is never broadcast. Null and empty texts
    # have no mark; each has a key of its own, so that they aren't one hot key.
    key = F.coalesce(F.when(F.length(text) > 0, F.md5(text)), F.concat(F.lit("-"), F.spark_partition_id().cast("string"), F.lit("-"), F.monotonically_increasing_id().cast("string")))
    rows = docs.withColumn("_pii_digest", key).join(marks.hint("merge"), "_pii_digest", "left").withColumn("_pii_base", F.coalesce("_pii_base", none))
    masks = F.array(*[F.lit(MASK[k]) for k in KINDS])
    base = F.transform("_pii_base", lambda s: F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["end"].alias("end"), F.element_at(masks, s["ord"] + 1).alias("instead")))
    terms = F.when(F.col("_pii_terms").isNotNull(), _terms(text, F.col("_pii_base"), F.col("_pii_terms")))
    return rows.withColumn("_pii_every", F.array_sort(F.concat(base, F.coalesce(terms, F.expr("cast(array() as array<struct<start:int,ord:int,end:int,instead:string>>)"))))).drop("_pii_digest", "_pii_terms")


def _count(place: int) -> Column:
    return F.size(F.filter("_pii_base", lambda s: s["ord"] == place)).cast("long")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 8, **thresholds: float) -> DataFrame:
    """``doc_id`` and ``OUT`` of every row."""
    rows = _marked(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", window, **thresholds)
    counts = [_count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(listed(F.col("_pii_base")), 256).alias("base_sha256"), listed(F.col("_pii_every")).alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its ``instead``; overlapping spans become the first one's."""
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        piece = F.array(F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), s["instead"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(spans, zero, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, acc["at"] + 1)))


def sanitise(docs: DataFrame, text_col: str = "text", window: int = 8, **thresholds: float) -> DataFrame:
    """``docs`` with personal data masked and disclosing terms removed or generalised; null texts stay null."""
    rows, text = _marked(docs, text_col, window, **thresholds), F.col(text_col)
    return rows.withColumn(text_col, F.when(F.size("_pii_every") > 0, masked(text, F.col("_pii_every"))).otherwise(text)).select(*docs.columns)
