"""Corpora from Parquet tables.

A corpus is a DataFrame ``(document, text)``.  Only the two columns a
query needs are selected, so the Parquet scan reads just those (column
pruning shows as ``ReadSchema`` in the plan).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(base, f"{name}.parquet"))


def _corpus(df: DataFrame, partitions: int | None) -> DataFrame:
    """``partitions``: deal the rows anew, round-robin, to so many tasks.

    Off by default: tokenising is narrow and follows the scan's splits
    (``spark.sql.files.maxPartitionBytes``, ``minPartitionNum``; a Parquet file
    splits at its row groups).  Ask for it only for a corpus stored as fewer
    row groups than there are cores; it shuffles the whole raw text.
    """
    return df if partitions is None else df.repartition(partitions)


def documents_corpus(spark: SparkSession, base: str, partitions: int | None = None) -> DataFrame:
    """``documents(doc_id, text, ...)`` with ``doc_id`` as the document key."""
    return _corpus(table(spark, base, "documents").select(F.col("doc_id").alias("document"), "text"), partitions)


def conversations_corpus(spark: SparkSession, base: str, partitions: int | None = None) -> DataFrame:
    """``conversations``: one document per turn, keyed ``"<conv_id>/<turn>"``."""
    key = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return _corpus(table(spark, base, "conversations").select(key.alias("document"), "text"), partitions)


def benchmark_corpus(spark: SparkSession, base: str, partitions: int | None = None) -> DataFrame:
    return _corpus(table(spark, base, "benchmark").select(F.col("item_id").alias("document"), "text"), partitions)


def pages_corpus(spark: SparkSession, base: str, partitions: int | None = None) -> DataFrame:
    """``pages(page_id, url, html)`` with the raw HTML as text."""
    pages = table(spark, base, "pages").select(F.col("page_id").alias("document"), F.col("html").alias("text"))
    return _corpus(pages, partitions)
