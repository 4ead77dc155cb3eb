"""Term tables: ``term_info``, ``doc_info``, ``term_doc_info``.

Input is a *corpus*: a DataFrame with columns ``document`` (the key, any
type) and ``text`` (string, may be NULL).  Everything that is per document is
computed inside the document's row (see ``functions.arrays``), so
``doc_terms``/``term_stats``/``term_info``/``doc_info`` are narrow: a scan,
one regex pass and a projection, no exchange.  Only cross-document
statistics (document frequency, corpus totals) shuffle, and those are
partially aggregated before the exchange, so a stop word present in every
document costs one row per map task, not one row per document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import run_struct, sorted_runs
from ..functions.tokens import word_array


def doc_terms(corpus: DataFrame) -> DataFrame:
    """Nested per-document form; one row per document (none dropped).

    Columns: ``document``, ``token_total`` (word tokens), ``term_count``
    (distinct cased terms), ``terms`` = array of struct(term, lower,
    occurence, lower_first) ordered by (lower, term).  ``lower_first`` marks
    the first cased variant of each lower-cased term in the document.
    """
    return doc_terms_from_words(corpus.select("document", word_array(F.col("text")).alias("words")))


def _sorted_words(words: DataFrame) -> DataFrame:
    """The words of each document sorted by (lower, term), with the ends of their runs."""
    # (lower, term) pairs without a per-element lambda: words hold no spaces,
    # so lower-casing the space-joined words and splitting again lines up.
    n = F.size("words")
    lowers = F.when(n > 0, F.split(F.lower(F.array_join("words", " ")), " ")).otherwise(
        F.array().cast("array<string>")
    )
    pairs = words.select(
        "document", F.arrays_zip(lowers.alias("lower"), F.col("words").alias("term")).alias("w")
    )
    # Sorted by (lower, term); the term alone decides equality.
    return sorted_runs(pairs, "w", ["document"], key=lambda e: e["term"])


def doc_terms_from_words(words: DataFrame) -> DataFrame:
    """``doc_terms`` from (document, words array<string>) in text order."""
    runs = _sorted_words(words)

    def build(v, count, prev):
        return F.struct(
            v["term"].alias("term"),
            v["lower"].alias("lower"),
            count.cast("long").alias("occurence"),
            (prev.isNull() | (prev["lower"] != v["lower"])).alias("lower_first"),
        )

    counted = run_struct(runs, ["document"], build)
    return counted.select(
        "document",
        F.col("_n").cast("long").alias("token_total"),
        F.col("_m").cast("long").alias("term_count"),
        F.col("_r").alias("terms"),
    )


def term_stats_from_words(words: DataFrame) -> DataFrame:
    """``term_stats`` from (document, words array<string>) in text order.

    A row per run of equal words, which reads its word and those of the run
    before at their places: plain expressions, compiled, where building the
    terms of a document first would be interpreted term by term.
    """
    # The _outer generator: see term_stats.
    rows = _sorted_words(words).select("document", "_s", "_e", "_n", F.posexplode_outer("_e").alias("_i", "_at"))
    rows = rows.where(F.col("_at").isNotNull())
    start = F.coalesce(F.get("_e", F.col("_i") - 1), F.lit(-1))
    word, before = F.get("_s", F.col("_at")), F.get("_s", start)
    occurence, term_count = (F.col("_at") - start).cast("long"), F.size("_e").cast("long")
    return rows.select(
        "document",
        word["term"].alias("term"),
        word["lower"].alias("lower"),
        occurence.alias("occurence"),
        (occurence / term_count.cast("double")).alias("frequency"),
        term_count.alias("term_count"),
        F.col("_n").cast("long").alias("token_total"),
        ((F.col("_i") == 0) | (before["lower"] != word["lower"])).alias("lower_first"),
        (F.col("_i") == 0).alias("doc_first"),
    )


def term_stats(corpus_or_doc_terms: DataFrame) -> DataFrame:
    """One row per (document, cased term), with per-document context.

    Columns: document, term, lower, occurence, frequency (occurence /
    term_count, the stored frequency), term_count, token_total, lower_first,
    doc_first (one row per document is flagged).  This is the enriched
    ``term_info`` that the scoring operators read.
    """
    if not _DOC_TERMS_COLS.issubset(corpus_or_doc_terms.columns):
        return term_stats_from_words(corpus_or_doc_terms.select("document", word_array(F.col("text")).alias("words")))
    dt = corpus_or_doc_terms
    # The _outer generator keeps Catalyst from inferring a ``size(terms) > 0``
    # filter, which it would push below the projections above and thereby
    # evaluate the whole tokenize-and-count chain a second time.
    rows = dt.select(
        "document",
        "token_total",
        "term_count",
        F.posexplode_outer("terms").alias("_i", "_t"),
    ).where(F.col("_t").isNotNull())
    return rows.select(
        "document",
        F.col("_t.term").alias("term"),
        F.col("_t.lower").alias("lower"),
        F.col("_t.occurence").alias("occurence"),
        (F.col("_t.occurence") / F.col("term_count").cast("double")).alias("frequency"),
        "term_count",
        "token_total",
        F.col("_t.lower_first").alias("lower_first"),
        (F.col("_i") == 0).alias("doc_first"),
    )


def term_info(corpus_or_stats: DataFrame) -> DataFrame:
    """``term_info(document, term, lower, occurence, frequency)``.

    Key (document, term, lower).  ``occurence`` counts word tokens;
    ``frequency`` is occurence over the document's distinct cased terms.
    """
    ts = _as_term_stats(corpus_or_stats)
    return ts.select("document", "term", "lower", "occurence", "frequency")


def doc_info(corpus_or_doc_terms: DataFrame) -> DataFrame:
    """``doc_info(document, term_count)``: the document registry.

    ``term_count`` is the number of distinct cased terms; documents without
    any word token are kept with 0.  Narrow: no join, no shuffle.
    """
    if "text" in corpus_or_doc_terms.columns:
        # Only the number of distinct words is needed: no sort, no explode.
        words = word_array(F.col("text"))
        return corpus_or_doc_terms.select(
            "document", F.size(F.array_distinct(words)).cast("long").alias("term_count")
        )
    dt = _as_doc_terms(corpus_or_doc_terms)
    return dt.select("document", "term_count")


def term_doc_info(corpus_or_stats: DataFrame) -> DataFrame:
    """``term_doc_info(term, doc_count)`` as built by the reference trigger.

    Counts (document, cased term) rows per lower-cased term, so ``Saluang``
    and ``saluang`` in one document add two.  For the true document
    frequency see ``scoring.doc_frequency``.
    """
    ts = _as_term_stats(corpus_or_stats)
    return ts.groupBy(F.col("lower").alias("term")).agg(F.count(F.lit(1)).alias("doc_count"))


def compound_terms(corpus_or_stats: DataFrame) -> DataFrame:
    """term_info rows whose term is a hyphen compound (``kira-kira``)."""
    from ..functions.tokens import is_compound

    return term_info(corpus_or_stats).where(is_compound(F.col("term")))


def term_postings(corpus_or_stats: DataFrame, word: str) -> DataFrame:
    """All term_info rows of one word, matched on the lower-cased form.

    On a stored Parquet ``term_info`` the equality reaches the scan as a
    pushed filter (and prunes row groups when files are sorted by lower).
    """
    return term_info(candidates(corpus_or_stats, word)).where(F.col("lower") == F.lower(F.lit(word)))


def candidates(corpus_or_stats: DataFrame, word: str) -> DataFrame:
    """Only the documents that can hold ``word`` (corpora; tables pass through).

    A word token is a substring of its text, so a document whose lower-cased
    text does not contain the lower-cased word cannot post it: an exact
    pre-filter that spares tokenizing the rest.
    """
    if "text" not in corpus_or_stats.columns:
        return corpus_or_stats
    return corpus_or_stats.where(F.lower(F.col("text")).contains(word.lower()))


# --- helpers -----------------------------------------------------------------

_DOC_TERMS_COLS = {"document", "token_total", "term_count", "terms"}
_STATS_COLS = {"lower_first", "doc_first", "token_total", "term_count"}


def _as_doc_terms(df: DataFrame) -> DataFrame:
    if _DOC_TERMS_COLS.issubset(df.columns):
        return df
    return doc_terms(df)


def _as_term_stats(df: DataFrame) -> DataFrame:
    cols = set(df.columns)
    if _STATS_COLS.issubset(cols) and "lower" in cols:
        return df
    if "text" in cols:
        return term_stats(df)
    if {"document", "term", "lower", "occurence"}.issubset(cols):
        return enrich_term_info(df)
    raise ValueError(f"expected a corpus or a term table, got columns {df.columns}")


def enrich_term_info(ti: DataFrame) -> DataFrame:
    """Add the per-document columns to a plain ``term_info`` table.

    For tables written elsewhere (without our helper columns).  One exchange by
    document and one sort by (document, lower): totals are windows over a
    document's rows, which wait on disk where there are too many for memory.
    """
    words = Window.partitionBy("document", "lower")
    whole = Window.partitionBy("document")
    known = ti.where(F.col("document").isNotNull()).repartition("document")  # rows without a key are left out
    columns = ["document", "term", "lower", "occurence"]
    out = known.select(*columns, F.min("term").over(words).alias("_lf_term"))
    out = out.select(
        "*",
        F.sum("occurence").over(whole).cast("long").alias("token_total"),
        F.count(F.lit(1)).over(whole).alias("term_count"),
        F.min(F.struct("lower", "term")).over(whole).alias("_first"),
    )
    return out.where(F.col("lower").isNotNull()).select(
        "document",
        "term",
        "lower",
        F.col("occurence").cast("long").alias("occurence"),
        (F.col("occurence") / F.col("term_count").cast("double")).alias("frequency"),
        "term_count",
        "token_total",
        (F.col("term") == F.col("_lf_term")).alias("lower_first"),
        ((F.col("_first.lower") == F.col("lower")) & (F.col("_first.term") == F.col("term"))).alias("doc_first"),
    )
