"""Corpus preparation: language, near duplicates, personal data, mixing, packing.

Each stage is written to the shared folder of the session and read again as the next
one's documents. All but the last return the columns of documents.

Defined cases of every stage: an empty table gives an empty one. Null, empty and letterless
texts go in the first stage, as they have no language; rows of null id, lang or source are
ordinary rows, a null source being a source of its own to the mix. Repeated rows are copies,
of which the second stage keeps one, that of the smallest id, null last, of equal ids any one;
the mix takes equal rows together. Very long texts are read whole. More columns than those of
documents are kept by all stages but the last, which gives its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagehand.llm import langid, mixing, packing, pii, simhash
from stagehand.llm.common import cut, forget, swept


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is recognised; texts without a letter go."""
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
    return langid.accepted(docs, langid.fit(docs, train))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies, the one of the smallest id."""
    return simhash.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data masked and disclosing terms removed or generalised."""
    return pii.sanitise(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's bucket, batch and place."""
    return packing.pack(docs, keep=("lang", "source", "n_chars"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mix),
    ("packing", pack),
]

#: SQL can't express the language model, the fingerprints and the bucket search.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES[:-1]:
        with swept(spark) as keep:
            docs = cut(stage(spark, docs, sf_dir))
            keep.append(docs)
        forget(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
