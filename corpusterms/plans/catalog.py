"""Registered queries: each runs an operator over the whole driver tables.

``QUERIES[name](spark, base_dir) -> DataFrame``.  Floating scores pass
through ``round_sig`` at the edge (the reference printed them rounded too),
so that a last-bit difference of a floating sum does not count as a
mismatch against the SQL oracle (``plans/oracle.py``).
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup
from ..functions.scores import IDF_LOG10, round_sig
from ..operators import key_index, long_texts, markdown, ngrams, postings, registry, scoring, terms, tokens
from ..sources import files, tables, wiki
from ..storage import scratch
from ..streaming import ingest

# Query parameters (the reference takes them on its command line).
WORD = "the"  # rank / word_idf / postings
TOP_K = 100  # top_terms
RANK_K = 10  # rank_word prints 10 postings
BATCH_SIZE = 50  # new_documents: documents per ingest run


def _r(df: DataFrame, *cols: str) -> DataFrame:
    """Round the named double columns to 9 significant digits."""
    return df.select(*[round_sig(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


def _docs(spark: SparkSession, base: str) -> DataFrame:
    return tables.documents_corpus(spark, base)


def q_tokens(spark, base):
    return tokens.tokens(_docs(spark, base))


def q_token_kinds(spark, base):
    return tokens.token_kinds(_docs(spark, base))


def q_term_info(spark, base):
    return terms.term_info(_docs(spark, base))


def q_doc_info(spark, base):
    return terms.doc_info(_docs(spark, base))


def q_term_doc_info(spark, base):
    return terms.term_doc_info(_docs(spark, base))


def q_compound_terms(spark, base):
    return terms.compound_terms(_docs(spark, base))


def q_term_postings(spark, base):
    return terms.term_postings(_docs(spark, base), WORD)


def q_corpus_counts(spark, base):
    return scoring.corpus_counts(_docs(spark, base))


def q_doc_tokens(spark, base):
    return scoring.doc_tokens(_docs(spark, base))


def q_term_frequency(spark, base):
    return scoring.term_frequency(_docs(spark, base))


def q_doc_frequency(spark, base):
    return scoring.doc_frequency(_docs(spark, base))


def q_doc_frequency_total(spark, base):
    return scoring.doc_frequency_total(_docs(spark, base))


def q_tf_idf(spark, base):
    return scoring.tf_idf(_docs(spark, base))


def q_tf_idf_series(spark, base):
    return _r(scoring.tf_idf_series(_docs(spark, base)), "idf")


def q_tf_idf_summary(spark, base):
    return _r(scoring.tf_idf_summary(_docs(spark, base)), "maxtfidf", "meantfidf", "mintfidf")


def q_tf_idf_summary_log10(spark, base):
    s = scoring.tf_idf_summary(_docs(spark, base), idf_mode=IDF_LOG10)
    return _r(s, "maxtfidf", "meantfidf", "mintfidf")


def q_top_terms(spark, base):
    return _r(scoring.top_terms(_docs(spark, base), TOP_K), "maxtfidf", "meantfidf", "mintfidf")


def q_word_idf(spark, base):
    return _r(scoring.word_idf(_docs(spark, base), WORD), "idf")


def q_rank_word(spark, base):
    return _r(scoring.rank_word(_docs(spark, base), WORD, k=RANK_K), "idf", "tfidf")


def q_registry_count(spark, base):
    return registry.registry_count(terms.doc_info(_docs(spark, base)))


def q_processed_documents(spark, base):
    return registry.processed_documents(terms.doc_info(_docs(spark, base)))


def q_new_documents(spark, base):
    # The labelled documents play the ledger of documents already ingested.
    ledger = tables.table(spark, base, "labels").select(F.col("doc_id").alias("document"))
    return registry.new_documents(_docs(spark, base), ledger, BATCH_SIZE)


def q_ngram_rows_2(spark, base):
    return ngrams.ngram_rows(_docs(spark, base), 2)


def q_ngram_rows_3(spark, base):
    return ngrams.ngram_rows(_docs(spark, base), 3)


def q_ngram_counts_2(spark, base):
    return ngrams.ngram_counts(_docs(spark, base), 2)


def q_ngram_counts_3(spark, base):
    return ngrams.ngram_counts(_docs(spark, base), 3)


def q_conversation_terms(spark, base):
    return terms.term_info(tables.conversations_corpus(spark, base))


def q_benchmark_summary(spark, base):
    s = scoring.tf_idf_summary(tables.benchmark_corpus(spark, base))
    return _r(s, "maxtfidf", "meantfidf", "mintfidf")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "tokens": q_tokens,
    "token_kinds": q_token_kinds,
    "term_info": q_term_info,
    "doc_info": q_doc_info,
    "term_doc_info": q_term_doc_info,
    "compound_terms": q_compound_terms,
    "term_postings": q_term_postings,
    "corpus_counts": q_corpus_counts,
    "doc_tokens": q_doc_tokens,
    "term_frequency": q_term_frequency,
    "doc_frequency": q_doc_frequency,
    "doc_frequency_total": q_doc_frequency_total,
    "tf_idf": q_tf_idf,
    "tf_idf_series": q_tf_idf_series,
    "tf_idf_summary": q_tf_idf_summary,
    "tf_idf_summary_log10": q_tf_idf_summary_log10,
    "top_terms": q_top_terms,
    "word_idf": q_word_idf,
    "rank_word": q_rank_word,
    "registry_count": q_registry_count,
    "processed_documents": q_processed_documents,
    "new_documents": q_new_documents,
    "ngram_rows_2": q_ngram_rows_2,
    "ngram_rows_3": q_ngram_rows_3,
    "ngram_counts_2": q_ngram_counts_2,
    "ngram_counts_3": q_ngram_counts_3,
    "conversation_terms": q_conversation_terms,
    "benchmark_summary": q_benchmark_summary,
}


# --- markup -------------------------------------------------------------------
# The driver documents hold no markup, so these queries dress each document
# in markup built from its own columns (front matter, heading, emphasis,
# links, quote, list, image, code, HTML, definition) and clean it again.

_Q3 = "'" * 3


def markdown_document(doc_id, lang, source, text):
    i = doc_id.cast("string")
    return F.concat(
        F.lit("---\ntitle: d"), i, F.lit("\nlang: "), lang, F.lit("\n---\n# "), source,
        F.lit("\n\n"), text,
        F.lit("\n\n> **"), lang, F.lit("** [pautan](http://x.example/"), i,
        F.lit(' "t") and `kod` <b>html</b>\n\n- item *'), source,
        F.lit('*\n\n![alt](i.png "tajuk")\n\n```\nfenced '), lang, F.lit('\n```\n\n[lab]: http://x "def"\n'),
    )


def wiki_document(doc_id, lang, source, text):
    i = doc_id.cast("string")
    return F.concat(
        F.lit("== "), source, F.lit(" ==\n" + _Q3), lang, F.lit(_Q3 + " "), text,
        F.lit(" [[Pautan|"), lang, F.lit("]] [[Fail:x.png|thumb|[[a]] cap]] {{cite|"), i,
        F.lit("}}<ref>r"), i, F.lit("</ref>\n* item "), i,
        F.lit("\n<!-- c -->[http://x.example/"), i, F.lit(" luar]\n"),
    )


def _dressed(spark, base, dress):
    d = tables.table(spark, base, "documents")
    return d.select(
        F.col("doc_id").alias("document"),
        dress(F.col("doc_id"), F.col("lang"), F.col("source"), F.col("text")).alias("raw"),
    )


def q_markdown_text(spark, base):
    md = _dressed(spark, base, markdown_document)
    return _squeezed(markdown.markdown_text(md.withColumnRenamed("raw", "text")))


def _squeezed(df):
    """White space in ``text`` carries no meaning for tokens: one space each."""
    # A single space is what it becomes: it is not replaced.
    return df.withColumn("text", F.trim(F.regexp_replace("text", r"[\t\r\n][ \t\r\n]*| [ \t\r\n]+", " ")))


def q_markdown_terms(spark, base):
    return terms.term_info(q_markdown_text(spark, base))


def q_front_matter(spark, base):
    md = _dressed(spark, base, markdown_document)
    fm = markup.split_front_matter(F.col("raw"))
    return md.select("document", fm["meta"].alias("meta"), fm["body"].alias("body"))


def q_wikitext_clean(spark, base):
    wk = _dressed(spark, base, wiki_document)
    return _squeezed(wk.select("document", markup.wikitext_clean(F.col("raw")).alias("text")))


def q_page_text(spark, base):
    p = tables.pages_corpus(spark, base)
    return _squeezed(p.select("document", markup.html_text(F.col("text")).alias("text")))


def q_page_terms(spark, base):
    return terms.term_info(q_page_text(spark, base))


QUERIES.update(
    {
        "markdown_text": q_markdown_text,
        "markdown_terms": q_markdown_terms,
        "front_matter": q_front_matter,
        "wikitext_clean": q_wikitext_clean,
        "page_text": q_page_text,
        "page_terms": q_page_terms,
    }
)


def q_term_tokens(spark, base):
    return tokens.term_tokens(_docs(spark, base))


def q_stored_frequency(spark, base):
    return scoring.stored_frequency(_docs(spark, base))


QUERIES.update({"term_tokens": q_term_tokens, "stored_frequency": q_stored_frequency})


def q_ngram_rows_window_2(spark, base):
    return ngrams.ngram_rows_from_tokens(tokens.tokens(_docs(spark, base)), 2)


def q_ngram_rows_window_3(spark, base):
    return ngrams.ngram_rows_from_tokens(tokens.tokens(_docs(spark, base)), 3)


QUERIES.update({"ngram_rows_window_2": q_ngram_rows_window_2, "ngram_rows_window_3": q_ngram_rows_window_3})


# --- texts in pieces ------------------------------------------------------------
# Pieces of a thousand characters: most texts of the driver's tables have some.

LEAST = 1000


def q_pieced_tokens(spark, base):
    return long_texts.tokens(_docs(spark, base), LEAST)


def q_pieced_term_info(spark, base):
    return long_texts.term_info(_docs(spark, base), LEAST)


def q_pieced_doc_info(spark, base):
    return long_texts.doc_info(_docs(spark, base), LEAST)


def q_pieced_ngram_rows_2(spark, base):
    return long_texts.ngram_rows(_docs(spark, base), 2, LEAST)


def q_pieced_ngram_counts_3(spark, base):
    return long_texts.ngram_counts(_docs(spark, base), 3, LEAST)


QUERIES.update(
    {
        "pieced_tokens": q_pieced_tokens,
        "pieced_term_info": q_pieced_term_info,
        "pieced_doc_info": q_pieced_doc_info,
        "pieced_ngram_rows_2": q_pieced_ngram_rows_2,
        "pieced_ngram_counts_3": q_pieced_ngram_counts_3,
    }
)


# --- wiki pages ---------------------------------------------------------------
# A page per document, built from its columns as the dump reader returns pages:
# the reader itself needs files, everything behind it is checked here.


def _pages(spark, base):
    from ..schemas import REVISION, WIKI_PAGE

    d = tables.table(spark, base, "documents")
    i = F.col("doc_id").cast("string")

    def revision(number, text):
        return F.struct(
            number.alias("id"),
            F.lit(None).cast("string").alias("parentid"),
            F.lit("2024-01-01T00:00:00Z").alias("timestamp"),
            F.struct(F.col("source").alias("username"), i.alias("id")).alias("contributor"),
            F.concat(F.lit("[[Muzik|"), F.col("lang"), F.lit("]] " + _Q3), i, F.lit(_Q3)).alias("comment"),
            F.lit("wikitext").alias("model"),
            F.lit("text/x-wiki").alias("format"),
            F.struct(text.alias("_VALUE")).alias("text"),
            F.lit(None).cast("string").alias("sha1"),
        ).cast(REVISION)

    # Every page has a second, older revision.
    text = F.when(F.col("text").isNotNull(), F.concat(F.lit("  "), F.col("text"), F.lit(" \u00a0\n\n\t== "), F.col("lang"), F.lit(" ==  \n")))
    return d.select(
        F.concat(F.lit("Page "), i).alias("title"),
        F.lit(0).cast("long").alias("ns"),
        F.col("doc_id").alias("id"),
        F.array(revision(F.concat(F.lit("r"), i), text), revision(F.concat(F.lit("old"), i), F.lit("old"))).alias("revision"),
    ).select(*[F.col(f.name).cast(f.dataType) for f in WIKI_PAGE.fields])


def q_page_documents(spark, base):
    docs = wiki.page_documents(_pages(spark, base))
    first = F.get(F.col("meta.revision"), 0)
    return docs.select("document", "text", "meta.title", first["comment"].alias("comment"), F.size("meta.revision").alias("revisions"))


def q_clean_documents(spark, base):
    docs = wiki.clean_documents(wiki.page_documents(_pages(spark, base)))
    meta = docs.select("document", F.get(F.col("meta.revision"), 0)["comment"].alias("comment"), F.size("meta.revision").alias("revisions"), "text")
    return _squeezed(meta)


def q_squeeze_lines(spark, base):
    d = tables.table(spark, base, "documents")
    lines = F.concat(F.lit(" \t"), F.col("text"), F.lit("  \n \n\n\u2003"), F.col("lang"), F.lit("\u00a0\n"))
    return d.select(F.col("doc_id").alias("document"), markup.squeeze_lines(lines).alias("text"))


def q_skip_done(spark, base):
    # The labelled documents play the outputs already there.
    done = tables.table(spark, base, "labels").select(F.concat(F.lit("r"), F.col("doc_id").cast("string"), F.lit(".wiki.md")).alias("document"))
    return wiki.clean_documents(wiki.page_documents(_pages(spark, base)), existing=done).select("document")


def q_wiki_terms(spark, base):
    return terms.term_info(wiki.page_corpus(_pages(spark, base)))


def q_dump_documents(spark, base):
    # The pages written as an XML dump to the shared folder, and read back.
    path = f"{scratch(spark)}/dump"
    wiki.write_wiki_dump(_pages(spark, base), path)
    docs = wiki.page_documents(wiki.read_wiki_pages(spark, path))
    first = F.get(F.col("meta.revision"), 0)
    return docs.select("document", "text", "meta.title", first["comment"].alias("comment"), F.size("meta.revision").alias("revisions"))


def q_folder_terms(spark, base):
    # The documents written as files, one each, to the shared folder, and read back.
    path = f"{scratch(spark)}/files"
    files.write_document_files(_docs(spark, base), path)
    return terms.term_info(files.read_document_files(spark, path))


QUERIES.update({"dump_documents": q_dump_documents, "folder_terms": q_folder_terms})
QUERIES.update(
    {
        "page_documents": q_page_documents,
        "clean_documents": q_clean_documents,
        "squeeze_lines": q_squeeze_lines,
        "skip_done": q_skip_done,
        "wiki_terms": q_wiki_terms,
    }
)


# --- one ingest batch -----------------------------------------------------------
# What a batch adds to each table of the store, the labelled documents being
# those already registered.


def _batch(name):
    def query(spark, base):
        ledger = tables.table(spark, base, "labels").select(F.col("doc_id").alias("document"))
        df = ingest.batch_tables(_docs(spark, base), ledger)[name]
        return terms.term_info(df) if name == "term_info" else df

    return query


def q_enriched_summary(spark, base):
    # A plain term table, as written elsewhere: the context columns come by aggregation.
    plain = terms.term_info(_docs(spark, base)).drop("frequency")
    return _r(scoring.tf_idf_summary(plain), "maxtfidf", "meantfidf", "mintfidf")


def q_summary_modes(spark, base):
    s = scoring.tf_idf_summary(
        _docs(spark, base), idf_mode=IDF_LOG10, with_stddev=True, tf_mode="vocab", df_mode="rows", n_mode="registry"
    )
    return _r(s, "maxtfidf", "meantfidf", "mintfidf", "sdtfidf")


def q_count_rows_2(spark, base):
    return ngrams.count_rows(ngrams.ngram_rows(_docs(spark, base), 2))


def q_rank_report(spark, base):
    return scoring.rank_report(scoring.rank_word(_docs(spark, base), WORD, k=RANK_K))


QUERIES.update({f"batch_{n}": _batch(n) for n in ("term_info", "doc_info", "term_doc_delta", "ngram_two", "ngram_three")})
QUERIES.update(
    {
        "enriched_summary": q_enriched_summary,
        "summary_modes": q_summary_modes,
        "count_rows_2": q_count_rows_2,
        "rank_report": q_rank_report,
    }
)


def _two_batches(spark, base):
    # The documents ingested by a store in two batches, the labelled ones first.
    store = f"{scratch(spark)}/store"
    docs = _docs(spark, base)
    labelled = tables.table(spark, base, "labels").select(F.col("doc_id").alias("document"))
    ingest.ingest_batch(spark, docs.join(labelled, "document", "left_semi"), store)
    ingest.ingest_batch(spark, docs, store)
    return store


def q_store_summary(spark, base):
    return _r(ingest.stored_summary(spark, _two_batches(spark, base)), "maxtfidf", "meantfidf", "mintfidf")


def q_store_term_doc_info(spark, base):
    return ingest.stored_term_doc_info(spark, _two_batches(spark, base))


QUERIES.update({"store_summary": q_store_summary, "store_term_doc_info": q_store_term_doc_info})


def q_rank_word_blocks(spark, base):
    docs, path = _docs(spark, base), f"{scratch(spark)}/postings"
    postings.write_postings(terms.term_info(docs), path)
    return _r(postings.top_postings(spark, path, WORD, terms.doc_info(docs), RANK_K), "idf", "tfidf")


QUERIES["rank_word_blocks"] = q_rank_word_blocks


def q_concurrent_batches(spark, base):
    # Two writers at the same moment: all documents, and the labelled ones.
    store = f"{scratch(spark)}/store"
    docs = _docs(spark, base)
    labelled = tables.table(spark, base, "labels").select(F.col("doc_id").alias("document"))
    with ThreadPoolExecutor(2) as pool:
        writers = [pool.submit(ingest.ingest_batch, spark, d, store) for d in (docs, docs.join(labelled, "document", "left_semi"))]
        for w in writers:
            w.result()
    return ingest.stored_tables(spark, store)["doc_info"]


def q_indexed_new_documents(spark, base):
    path = f"{scratch(spark)}/keys"
    labelled = tables.table(spark, base, "labels").select(F.col("doc_id").alias("document"))
    return key_index.indexed_new_documents(_docs(spark, base), path, key_index.build(labelled, path))


QUERIES.update({"concurrent_batches": q_concurrent_batches, "indexed_new_documents": q_indexed_new_documents})
