"""The queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_extract, langid, lexical, lm, media, mixing, packing, pii, quality, resample, secrets, simhash, topk
from .common import cut


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(modulus: int):
    """crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media(_table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = cut(quality.measure(_table(spark, sf_dir, "documents")))
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).filter("label in (0, 1)")
    model = quality.fit(measured.filter(_fold(5) != 0).join(labels, "doc_id"))
    held = F.coalesce(_fold(5) == 0, F.lit(False))
    return quality.score(measured, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs, _fold(4) != 2)
    held = F.coalesce(_fold(4) == 2, F.lit(False))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiled = mixing.profile(_table(spark, sf_dir, "documents"))
    mixed = mixing.apply_plan(profiled, mixing.plan(profiled))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP8_SQL = r"""
WITH docs AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS s,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS k
  FROM documents),
sizes AS (SELECT s, sum(size)::BIGINT AS source_size FROM docs GROUP BY s),
ranked AS (SELECT *, row_number() OVER (ORDER BY encode(s)) - 1 AS r FROM sizes),
weighed AS (SELECT *, CASE r % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 3 * source_size AS cap FROM ranked),
levels AS (
  SELECT *, cap::DOUBLE / w AS ratio,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER o, 0))::DOUBLE AS lvl
  FROM weighed WINDOW o AS (ORDER BY cap::DOUBLE / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
free AS (SELECT ratio AS fratio, r AS fr, lvl AS flvl FROM levels WHERE ratio > lvl ORDER BY ratio, r LIMIT 1),
targets AS (
  SELECT s, source_size, CASE WHEN flvl IS NULL OR (ratio, r) < (fratio, fr) THEN cap::DOUBLE ELSE w * flvl END AS target
  FROM levels LEFT JOIN free ON true),
queued AS (
  SELECT docs.*, source_size, target, sum(size) OVER (PARTITION BY docs.s ORDER BY k) AS cum
  FROM docs JOIN targets USING (s)),
copies AS (
  SELECT s, k, size, e, (e * source_size + cum)::DOUBLE / target AS t
  FROM queued, (VALUES (0), (1), (2)) AS v(e) WHERE size > 0),
times AS (SELECT t, sum(sum(size)) OVER (ORDER BY t) AS upto FROM copies GROUP BY t),
until AS (SELECT max(t) AS t FROM times WHERE upto <= (SELECT sum(source_size) FROM sizes)),
bounds AS (SELECT s, e, max(k) AS k FROM copies WHERE t <= (SELECT t FROM until) GROUP BY s, e)
SELECT doc_id, size, source_size, target,
       (size * (SELECT count(*) FROM bounds b WHERE b.s = q.s AND q.k <= b.k))::BIGINT AS taken
FROM queued q
"""

QUERIES = {"op1_packing": op1_packing, "op2_media": op2_media, "op3_quality": op3_quality, "op6_langid": op6_langid, "op7_simhash": op7_simhash, "op8_mixing": op8_mixing}
ORACLES = {"op8_mixing": OP8_SQL}


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


QUERIES |= {"op4_pii": op4_pii, "op9_secrets": op9_secrets}


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP5_SQL = """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM good q, good c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


QUERIES |= {"op5_topk": op5_topk, "op10_html": op10_html}
ORACLES |= {"op5_topk": OP5_SQL}


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH RECURSIVE steps AS (
  SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) AS r(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
docs AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
goal AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
seen AS (
  SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM docs WHERE len(w) > 0),
wanted AS (
  SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM goal WHERE len(w) > 0),
runs AS (SELECT f FROM seen UNION SELECT f FROM wanted),
hexed AS (SELECT f, hex(encode(f)) AS h FROM runs),
sums AS (
  SELECT f, list_reduce(list_transform(range(0, len(h) // 2), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT),
                        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT) AS c
  FROM hexed, crc),
buckets AS (SELECT f, xor(c, 4294967295::BIGINT) % 10000 AS bucket FROM sums),
s AS (SELECT bucket, count(*) AS s FROM seen JOIN buckets USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM wanted JOIN buckets USING (f) GROUP BY bucket),
totals AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS ss, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS tt),
gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (ss + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * (tt + 10000))))::BIGINT AS gain
  FROM s FULL JOIN t USING (bucket), totals),
weights AS (
  SELECT doc_id, count(*)::BIGINT AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
  FROM seen JOIN buckets USING (f) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT doc_id, coalesce(len(w), 0) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM docs LEFT JOIN weights USING (doc_id)),
able AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS many FROM scored WHERE words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * many // 100 THEN place END AS rank
FROM scored LEFT JOIN able USING (doc_id)
"""
QUERIES |= {"op12_resample": op12_resample}
ORACLES |= {"op12_resample": OP12_SQL}


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.top_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
totals AS (SELECT count(*)::BIGINT AS n, sum(len(w))::BIGINT AS l FROM docs WHERE len(w) > 0),
postings AS (
  SELECT doc_id, term, tf::BIGINT AS tf, many::BIGINT AS many
  FROM (SELECT doc_id, term, count(*) AS tf, any_value(many) AS many FROM (SELECT doc_id, unnest(w) AS term, len(w) AS many FROM docs WHERE len(w) > 0) GROUP BY doc_id, term)
  WHERE term IN (SELECT term FROM asked)),
weights AS (SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), totals),
impacts AS (SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * many * n) // l)) AS impact FROM postings, totals),
scored AS (SELECT item_id, doc_id, sum(w * impact)::BIGINT AS score FROM asked JOIN weights USING (term) JOIN impacts USING (term) GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
QUERIES |= {"op13_lexical": op13_lexical}
ORACLES |= {"op13_lexical": OP13_SQL}


def op11_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(_fold(7) == 2, F.lit(False))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", held.alias("held_out"))
    model = lm.fit(docs, _fold(7) != 2)
    return lm.score(docs, model, keep=("doc_id", "held_out"))


QUERIES |= {"op11_lm": op11_lm}
