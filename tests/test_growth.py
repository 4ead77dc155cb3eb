"""What is shuffled, joined and listed grows no faster than the input."""

import os

from pyspark.sql import functions as F

from corpusterms.functions import markup
from corpusterms.operators import long_texts, ngrams, scoring, terms, tokens
from corpusterms.sources import files


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def bag(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def _corpus(spark):
    rows = [(i, f"Kata kata {i} dan lain, kata-kata " * (1 + 40 * (i % 3))) for i in range(40)] + [(40, None), (None, "a b c"), (3, "x Y")]
    return spark.createDataFrame(rows, "document long, text string")


def test_tokens_of_pieces_are_not_shuffled(spark):
    corpus = _corpus(spark)
    got = long_texts.tokens(corpus, 50)
    assert plan(got).count("Exchange hashpartitioning") == 1  # of the texts
    assert bag(got) == bag(tokens.tokens(corpus))


def test_counts_of_short_texts_are_not_shuffled(spark):
    corpus = _corpus(spark)
    assert plan(long_texts.ngram_rows(corpus, 2, 50)).count("Exchange hashpartitioning") == 1
    for got, want in (
        (long_texts.term_info(corpus, 50), terms.term_info(corpus)),
        (long_texts.doc_info(corpus, 50), terms.doc_info(corpus)),
        (long_texts.ngram_counts(corpus, 3, 50), ngrams.ngram_counts(corpus, 3)),
    ):
        assert bag(got) == bag(want)


def test_grouped_bags_ship_terms_alone(spark):
    rows = [(1, "A b", "a", "b", 1), (1, "A b", "a", "b", 2), (1, "A b", "x", None, 4), (None, None, None, None, 1), (1, "a b c", "a b", "c", 1)]
    rows = spark.createDataFrame(rows, "document long, term string, lower1 string, lower2 string, occurence long")
    got = ngrams.count_rows(rows)
    shuffled = next(x for x in plan(got).splitlines() if "Exchange" in x)
    assert "lower" not in shuffled
    assert got.columns == rows.columns
    keys = ["document", "term", "lower1", "lower2"]
    assert bag(got) == bag(rows.groupBy(*keys).agg(F.sum("occurence").alias("occurence")))


def test_windows_over_tokens_take_words_alone(spark):
    corpus = _corpus(spark).where("document is not null").dropDuplicates(["document"])
    got = ngrams.ngram_rows_from_tokens(tokens.tokens(corpus).localCheckpoint(), 3)
    below = plan(got).split("Exchange", 1)[1]
    assert "Filter" in below and "kind" not in plan(got).split("Exchange", 1)[0]
    assert bag(got) == bag(ngrams.ngram_rows(corpus, 3))


def test_plain_term_tables_are_read_once(spark):
    corpus = _corpus(spark).where("document is not null").dropDuplicates(["document"])
    plain = terms.term_info(corpus).drop("frequency")
    got = terms.enrich_term_info(plain)
    assert "Join" not in plan(got) and plan(got).count("Exchange") == 1
    columns = ["document", "term", "occurence", "term_count", "token_total", "lower_first", "doc_first"]
    assert bag(got.select(columns)) == bag(terms.term_stats(corpus).select(columns))
    assert bag(scoring.doc_frequency(plain)) == bag(scoring.doc_frequency(corpus))


def test_texts_come_to_python_in_bounded_batches(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.unset(name)
    try:
        markup.wikitext_clean(F.col("text"))
        assert int(spark.conf.get(name)) <= 8 << 20
        spark.conf.unset(name)
        markup.html_text(F.col("text"))
        assert int(spark.conf.get(name)) <= 8 << 20
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def test_document_files_lie_in_a_bounded_number_of_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "FOLDERS", 4)
    docs = spark.createDataFrame([(f"a/b={i}", f"text {i}") for i in range(60)], "document string, text string")
    files.write_document_files(docs, str(tmp_path / "files"))
    assert len([n for n in os.listdir(tmp_path / "files") if n.startswith("folder=")]) <= 4
    assert bag(files.read_document_files(spark, str(tmp_path / "files"))) == bag(docs)
