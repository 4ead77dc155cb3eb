"""Token stream operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import KIND_TEXT, token_array, token_kind


def token_lists(corpus: DataFrame) -> DataFrame:
    """(document, tokens): the ordered non-white-space tokens of each text."""
    return corpus.select("document", token_array(F.col("text")).alias("tokens"))


def tokens(corpus: DataFrame) -> DataFrame:
    """One row per token: (document, pos, token, kind).

    ``pos`` is the 0-based position among the kept (non-white-space) tokens;
    ``kind`` is text, punct or omit.  Narrow: one regex pass and an explode.
    """
    t = token_lists(corpus).select("document", F.posexplode_outer("tokens").alias("pos", "token")).where(
        F.col("token").isNotNull()
    )
    return t.select("document", F.col("pos").cast("long").alias("pos"), "token", token_kind(F.col("token")).alias("kind"))


def term_tokens(corpus: DataFrame) -> DataFrame:
    """Word tokens only (kind = text), with their stream position."""
    return tokens(corpus).where(F.col("kind") == KIND_TEXT)


def token_kinds(corpus: DataFrame) -> DataFrame:
    """Token count and distinct tokens per kind over the corpus."""
    t = tokens(corpus)
    per = t.groupBy("kind", "token").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("kind").agg(
        F.sum("n").cast("long").alias("tokens"), F.count(F.lit(1)).alias("distinct_tokens")
    )
