"""Impact-ordered postings: the best documents of a word without reading them all.

``write_postings`` stores a term table in order of (word, frequency falling,
document, term), in blocks of consecutive rows, and beside it, per word and
block, the number of its postings and their greatest frequency.  The order is a
range partitioning, so the postings of a stop word are many blocks of many
tasks.  ``top_postings`` reads a word's block table (a row per thousand
postings), then only the blocks that can hold one of the best ``k``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scores import IDF_LOG10, idf
from .scoring import rank_word

#: Rows of a block.
BLOCK = 1024


def write_postings(term_table: DataFrame, path: str, block: int = BLOCK) -> None:
    """``<path>/postings`` and ``<path>/blocks`` of a term table (document, term, lower, occurence, frequency)."""
    spark = term_table.sparkSession
    order = [F.col("lower"), F.desc("frequency"), F.col("document"), F.col("term")]
    rows = term_table.select("document", "term", "lower", "occurence", "frequency")
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # Numbered where they lie, in the order they are written: a task's rows follow each other.
    number = F.monotonically_increasing_id()
    placed = ordered.withColumn("part", F.spark_partition_id()).withColumn("number", number)
    placed = placed.withColumn("block", F.expr(f"(number & 8589934591) div {int(block)}"))
    placed.drop("number").write.mode("overwrite").parquet(os.path.join(path, "postings"))
    stored = spark.read.parquet(os.path.join(path, "postings"))
    blocks = stored.groupBy("lower", "part", "block").agg(
        F.count(F.lit(1)).alias("postings"), F.max("frequency").alias("most"), F.min("frequency").alias("least")
    )
    blocks.repartitionByRange("lower", "part", "block").sortWithinPartitions("lower", "part", "block").write.mode(
        "overwrite"
    ).parquet(os.path.join(path, "blocks"))


def chosen_blocks(blocks: DataFrame, word: str, documents: int, k: int) -> tuple[int, list[tuple[int, int]]]:
    """(postings of the word, the blocks that can hold one of its best ``k``)."""
    mine = blocks.where(F.col("lower") == F.lower(F.lit(word)))
    total = mine.agg(F.coalesce(F.sum("postings"), F.lit(0))).first()[0]
    along = Window.partitionBy("lower").orderBy("part", "block")
    before = F.coalesce(F.sum("postings").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = mine.withColumn("before", before).where(F.col("before") < k).orderBy("part", "block").collect()
    if not first:
        return total, []
    # A lesser frequency may still have the same score when it is multiplied.
    score = idf(F.lit(documents), F.lit(total), IDF_LOG10)
    bound = first[-1]["least"]
    level = mine.where((F.col("most") < bound) & (F.col("most") * score >= F.lit(bound) * score)).collect()
    return total, [(r["part"], r["block"]) for r in [*first, *level]]


def top_postings(spark: SparkSession, path: str, word: str, registry: DataFrame, k: int = 10) -> DataFrame:
    """``scoring.rank_word`` from stored postings.

    Where the word is in so many rows that its IDF is not positive, the least
    frequencies score best: then all its postings are ranked.
    """
    postings = spark.read.parquet(os.path.join(path, "postings"))
    blocks = spark.read.parquet(os.path.join(path, "blocks"))
    documents = registry.count()
    total, chosen = chosen_blocks(blocks, word, documents, k)
    mine = postings.where(F.col("lower") == F.lower(F.lit(word)))
    if documents <= 1 + total:
        return rank_word(_plain(mine), word, registry=registry, k=k)
    at = F.lit(False)
    for part, block in chosen:
        at = at | ((F.col("part") == part) & (F.col("block") == block))
    score = idf(F.lit(documents), F.lit(total), IDF_LOG10)
    ranked = mine.where(at).select(
        "document",
        "term",
        "lower",
        "occurence",
        "frequency",
        score.alias("idf"),
        (F.coalesce("frequency", F.lit(0.0)) * score).alias("tfidf"),
    )
    return ranked.orderBy(F.desc("tfidf"), "document", "term").limit(k)


def _plain(rows: DataFrame) -> DataFrame:
    """The columns that the scoring operators take for a term table."""
    return rows.select("document", "term", "lower", "occurence", "frequency").select(
        "*",
        F.lit(0).cast("long").alias("term_count"),
        F.lit(0).cast("long").alias("token_total"),
        F.lit(False).alias("lower_first"),
        F.lit(False).alias("doc_first"),
    )
