"""A training-data pipeline over ``documents``, in four stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is
written as Parquet to the shared folder and reread as the next stage's
``docs``, so that a lost executor costs no earlier stage.  All but the last
return the columns of ``documents``.

1. language ID: documents in none of the languages learnt from the labelled
   rows go (so do documents without a letter);
2. exact dedup: of equal texts, the row of the smallest ``doc_id`` stays;
3. n-gram Jaccard join: of each group of near copies, the same;
4. packing: a row per piece of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusterms.llm import exact_dedup, language_id, ngram_join
from corpusterms.llm.common import scratch, stored, table
from corpusterms.llm.queries import packed_pieces


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.drop_unknown(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.drop_near_copies(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed_pieces(docs)


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", without_copies),
    ("ngram_join", without_near_copies),
    ("packing", packed),
]

#: Language models and the tokenizer's merges are beyond SQL; the tests hold the
#: pipeline against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"{path}/{number}-{name}")
    return docs
