"""Corpus statistics and TF-IDF scoring over a term table.

All operators take the enriched term table (``terms.term_stats``), a plain
``term_info`` table, or a corpus, and return DataFrames.

Shape of the plans:

* per-row measures (``term_frequency``) are projections, no shuffle;
* per-term measures (``doc_frequency``, ``tf_idf_summary``) are one
  ``groupBy(lower)`` with partial aggregation, so a term that occurs in every
  document sends one row per map task across the network;
* the document total N is the sum, over that same aggregate, of a flag that
  one row per document carries: a scalar subquery whose exchange AQE reuses, so
  the text is scanned and tokenised once;
* the summary never joins the document frequency back onto the term rows:
  the IDF is constant within a term, so max/min/mean of tf*idf follow from
  max/min/mean of tf;
* the per-row ``tf_idf`` listing and ``rank_word`` read their rows twice: from
  a corpus they first write them to the shared folder (they run jobs when
  called, not only when their result is read).  ``tf_idf`` joins two stored
  tables, so that AQE can split the partition of a word that is in every
  document (which it can't when one side is an aggregate).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import IDF_LOG10, IDF_SERIES, idf
from ..functions.tokens import word_array
from ..storage import stored
from .terms import _as_term_stats, candidates, doc_info


# --- corpus totals -------------------------------------------------------------


def _per_term(ts: DataFrame, *aggregates: Column) -> DataFrame:
    """(lower, docfreq, n_first, aggregates): ``n_first`` adds up to N.

    ``n_first`` counts the documents whose flagged row this term is.
    """
    return ts.groupBy("lower").agg(
        F.sum(F.col("lower_first").cast("long")).alias("docfreq"),
        F.sum(F.col("doc_first").cast("long")).alias("n_first"),
        *aggregates,
    )


def _with_total(per_term: DataFrame, name: str = "doctotal") -> DataFrame:
    """``per_term`` with N, the documents with at least one term, beside it.

    N is a scalar subquery over the same aggregate (``COUNT(DISTINCT
    document)``, as each document flags one row).  Query and subquery both ask
    for every column of the aggregate (a condition that always holds), so
    neither is pruned to a plan of its own: AQE finds the exchange done and
    reuses it instead of reading the corpus again.
    """
    holds = F.lit(True)
    for c in per_term.columns:
        if c != "lower":
            holds = holds & (F.col(c).isNotNull() if c != "tf_sd" else F.col(c).isNull() | (F.col(c) >= 0))
    n = per_term.agg(F.sum(F.when(holds, F.col("n_first"))).alias("n")).scalar()
    return per_term.select("*", F.when(holds, n).alias(name))


def _n_registry(registry: DataFrame) -> Column:
    """Rows of the document registry (documents without terms included)."""
    return registry.agg(F.count(F.lit(1)).alias("n")).scalar()


def corpus_counts(corpus_or_stats: DataFrame) -> DataFrame:
    """One row: documents, unique_tokens (distinct lower), token_total.

    One pass: a per-term partial aggregate, then a one-row total.
    """
    ts = _as_term_stats(corpus_or_stats)
    per_term = _per_term(ts, F.sum("occurence").alias("occ"))
    return per_term.agg(
        F.sum("n_first").cast("long").alias("documents"),
        F.count(F.lit(1)).alias("unique_tokens"),
        F.sum("occ").cast("long").alias("token_total"),
    )


def doc_tokens(corpus_or_stats: DataFrame) -> DataFrame:
    """Word-token total per document that has terms: (document, token_total)."""
    if "text" in corpus_or_stats.columns:
        n = F.size(word_array(F.col("text"))).cast("long")
        return corpus_or_stats.select("document", n.alias("token_total")).where(F.col("token_total") > 0)
    ts = _as_term_stats(corpus_or_stats)
    return ts.where("doc_first").select("document", "token_total")


def term_frequency(corpus_or_stats: DataFrame) -> DataFrame:
    """TF per cased term row: occurence / token total of its document."""
    ts = _as_term_stats(corpus_or_stats)
    return ts.select(
        "document",
        "term",
        "lower",
        (F.col("occurence") / F.col("token_total").cast("double")).alias("frequency"),
    )


def doc_frequency(corpus_or_stats: DataFrame) -> DataFrame:
    """Documents per lower-cased term (true DF): (lower, docfreq)."""
    ts = _as_term_stats(corpus_or_stats)
    return ts.groupBy("lower").agg(F.sum(F.col("lower_first").cast("long")).alias("docfreq"))


def doc_frequency_total(corpus_or_stats: DataFrame) -> DataFrame:
    """``doc_frequency`` with the corpus document total beside it."""
    return _with_total(_per_term(_as_term_stats(corpus_or_stats))).select("lower", "docfreq", "doctotal")


def tf_idf(corpus_or_stats: DataFrame) -> DataFrame:
    """Per term row: tf, docfreq, doctotal and N/df, ordered by docfreq.

    The order is total (docfreq, lower, document, term) so that the range
    partitioning behind the sort can split a term that is in every document.
    """
    ts = _as_term_stats(corpus_or_stats)
    if "text" in corpus_or_stats.columns:
        ts = stored(ts.select("document", "term", "lower", "occurence", "token_total", "lower_first", "doc_first"))
    per_term = stored(_per_term(ts))
    n = per_term.agg(F.sum("n_first")).scalar()
    tf = ts.select(
        "document",
        "term",
        "lower",
        (F.col("occurence") / F.col("token_total").cast("double")).alias("tf"),
    )
    out = tf.join(per_term.select("lower", "docfreq"), "lower").select(
        "document", "term", "lower", "tf", "docfreq", n.alias("doctotal")
    )
    out = out.withColumn("power_of_idf", idf(F.col("doctotal"), F.col("docfreq"), "ratio"))
    return out.orderBy("docfreq", "lower", "document", "term")


def tf_idf_series(corpus_or_stats: DataFrame, idf_mode: str = IDF_SERIES) -> DataFrame:
    """IDF per lower-cased term: (lower, docfreq, doctotal, idf)."""
    dft = doc_frequency_total(corpus_or_stats)
    return dft.withColumn("idf", idf(F.col("doctotal"), F.col("docfreq"), idf_mode))


def tf_idf_summary(
    corpus_or_stats: DataFrame,
    idf_mode: str = IDF_SERIES,
    with_stddev: bool = False,
    tf_mode: str = "tokens",
    df_mode: str = "documents",
    n_mode: str = "terms",
    registry: DataFrame | None = None,
) -> DataFrame:
    """Max / mean / min of tf*idf per lower-cased term, best first.

    The mean runs over term rows (cased variants count separately), as in
    the SQL recipe.  One aggregation, no join: idf is constant in a group,
    multiplication by it is monotone, so max(tf*idf) = idf*max(tf) when
    idf >= 0 and idf*min(tf) otherwise.  ``with_stddev`` adds the sample
    standard deviation over term rows (|idf| * stddev(tf)), the spread
    measure the reference left as an open idea.

    Modes (defaults are the SQL recipe's): ``tf_mode`` "tokens" (occurence /
    word tokens of the document) or "vocab" (the stored frequency,
    occurence / distinct cased terms); ``df_mode`` "documents" (distinct
    documents) or "rows" (cased term rows, as the trigger counted);
    ``n_mode`` "terms" (documents with terms) or "registry" (all registered
    documents; pass ``registry`` unless a corpus is given).
    """
    ts = _as_term_stats(corpus_or_stats)
    if tf_mode == "tokens":
        tf = F.col("occurence") / F.col("token_total").cast("double")
    elif tf_mode == "vocab":
        tf = F.col("frequency")
    else:
        raise ValueError("tf_mode must be 'tokens' or 'vocab'")
    if df_mode == "documents":
        df = F.sum(F.col("lower_first").cast("long"))
    elif df_mode == "rows":
        df = F.count(F.lit(1))
    else:
        raise ValueError("df_mode must be 'documents' or 'rows'")
    sd = [F.stddev_samp(tf).alias("tf_sd")] if with_stddev else []
    per_term = _per_term(
        ts, F.max(tf).alias("tf_max"), F.min(tf).alias("tf_min"), F.avg(tf).alias("tf_mean"), df.alias("df"), *sd
    )
    # N as its own column: the IDF formula reads it many times, and a
    # non-trivial column referenced repeatedly stays one projection (one
    # subquery) instead of being inlined into every use.
    if n_mode == "terms":
        per_term = _with_total(per_term, "_n")
    elif n_mode == "registry":
        per_term = per_term.select("*", _n_registry(_registry_for(corpus_or_stats, registry)).alias("_n"))
    else:
        raise ValueError("n_mode must be 'terms' or 'registry'")
    w = idf(F.col("_n"), F.col("df"), idf_mode)
    scored = per_term.select("*", w.alias("_idf"))
    i = F.col("_idf")
    hi = F.when(i >= 0, i * F.col("tf_max")).otherwise(i * F.col("tf_min"))
    lo = F.when(i >= 0, i * F.col("tf_min")).otherwise(i * F.col("tf_max"))
    cols = [hi.alias("maxtfidf"), (i * F.col("tf_mean")).alias("meantfidf"), lo.alias("mintfidf"), F.col("lower")]
    if with_stddev:
        cols.append((F.abs(i) * F.col("tf_sd")).alias("sdtfidf"))
    return scored.select(*cols).orderBy(F.desc("maxtfidf"), "lower")


def top_terms(corpus_or_stats: DataFrame, k: int = 100, idf_mode: str = IDF_SERIES) -> DataFrame:
    """The ``k`` terms with the best maximum TF-IDF (top-k, ties by lower).

    ``orderBy(...).limit(k)`` plans as TakeOrderedAndProject: each task
    keeps its own top k, only k rows per task reach the final merge.
    """
    return tf_idf_summary(corpus_or_stats, idf_mode).limit(k)


# --- one word ------------------------------------------------------------------


def _registry_for(corpus_or_stats: DataFrame, registry: DataFrame | None) -> DataFrame:
    if registry is not None:
        return registry
    if "text" in corpus_or_stats.columns:
        return doc_info(corpus_or_stats)
    raise ValueError("pass the document registry (doc_info) to count N")


def word_idf(
    corpus_or_stats: DataFrame, word: str, registry: DataFrame | None = None
) -> DataFrame:
    """IDF of one word, log10(N / (1 + postings)); N = registry rows.

    As built, postings counts cased term rows (a document holding ``Kata``
    and ``kata`` counts twice).  An unknown word gets log10(N).
    """
    reg = _registry_for(corpus_or_stats, registry)
    ts = _as_term_stats(candidates(corpus_or_stats, word))
    w = F.lower(F.lit(word))
    postings = ts.where(F.col("lower") == w).agg(F.count(F.lit(1)).alias("postings"))
    n = _n_registry(reg)
    return postings.select(
        w.alias("word"),
        n.alias("documents"),
        "postings",
        idf(n, F.col("postings"), IDF_LOG10).alias("idf"),
    )


def rank_word(
    corpus_or_stats: DataFrame, word: str, registry: DataFrame | None = None, k: int = 10
) -> DataFrame:
    """Top-``k`` postings of one word by tf*idf (tf = stored frequency).

    Order: tfidf desc, document, term (the reference printed its first rows
    in storage order, which Spark does not have).
    """
    reg = _registry_for(corpus_or_stats, registry)
    ts = _as_term_stats(candidates(corpus_or_stats, word))
    w = F.lower(F.lit(word))
    postings = ts.where(F.col("lower") == w).select(
        "document", "term", "lower", "occurence", "frequency"
    )
    if "text" in corpus_or_stats.columns:  # tokenise the candidates once
        postings = stored(postings)
    n_post = postings.agg(F.count(F.lit(1)).alias("c")).scalar()
    i = idf(_n_registry(reg), n_post, IDF_LOG10)
    out = postings.select(
        "document",
        "term",
        "lower",
        "occurence",
        "frequency",
        i.alias("idf"),
        (F.coalesce(F.col("frequency"), F.lit(0.0)) * i).alias("tfidf"),
    )
    return out.orderBy(F.desc("tfidf"), "document", "term").limit(k)


def stored_frequency(corpus_or_stats: DataFrame) -> DataFrame:
    """The frequency the term table stores: occurence / distinct cased terms.

    (document, term, lower, frequency), per row; the per-document term count
    is known inside the document's row, so no join to ``doc_info`` is needed.
    """
    ts = _as_term_stats(corpus_or_stats)
    return ts.select("document", "term", "lower", "frequency")


def rank_report(ranked: DataFrame, places: int = 5) -> DataFrame:
    """``rank_word`` output as printable lines, scores to ``places`` decimals."""
    from ..functions.scores import format_score

    return ranked.select(
        F.concat(
            F.lit("TFIDF is "), format_score(F.col("tfidf"), places),
            F.lit(" for "), F.col("document").cast("string"), F.lit(" "), F.col("term"),
        ).alias("line")
    )
