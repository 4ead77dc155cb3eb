"""Texts in pieces, tokens in blocks: equal to the uncut results."""

import random

import pytest
from pyspark.sql import functions as F

from corpusterms.operators import long_texts, ngrams, terms, tokens


def bag(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def _texts():
    rnd = random.Random(6)
    words = ["ab", "c-d", "e", "1", "f-g-h", " ", "\n", "\t", ",", "{|", "{", "|", "é", "?", "_", "x" * 30, "  ", "{{|", "|}"]
    texts = ["".join(rnd.choice(words) + rnd.choice(["", " "]) for _ in range(rnd.randrange(80))) for _ in range(150)]
    texts += [None, "", " ", "{| a b c d e f", "a {| b c\nd e é f g {| h", "a " * 200, "a" * 200, "漢字" * 100, "? ? ?", "\u2003 a \u00a0b"]
    return texts


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i % 150, t) for i, t in enumerate(_texts())]  # some names come again
    return spark.createDataFrame(rows, "document long, text string").repartition(3)


@pytest.mark.parametrize("least", [1, 50])
def test_pieces_give_what_whole_texts_give(corpus, least):
    assert bag(long_texts.tokens(corpus, least)) == bag(tokens.tokens(corpus))
    assert bag(long_texts.term_info(corpus, least)) == bag(terms.term_info(corpus))
    assert bag(long_texts.doc_info(corpus, least)) == bag(terms.doc_info(corpus))
    for n in (2, 3):
        assert bag(long_texts.ngram_rows(corpus, n, least)) == bag(ngrams.ngram_rows(corpus, n))
        assert bag(long_texts.ngram_counts(corpus, n, least)) == bag(ngrams.ngram_counts(corpus, n))


def test_one_long_text_uses_many_tasks(spark):
    rnd = random.Random(1)
    text = " ".join(f"word{rnd.randrange(5000)}" + rnd.choice(["", "", ",", "?"]) for _ in range(60_000))
    corpus = spark.createDataFrame([(1, text)], "document long, text string")
    pieces = long_texts.text_pieces(corpus, 3_000)
    sizes = [r[0] for r in pieces.select(F.length("text")).collect()]
    assert len(sizes) > 100 and max(sizes) < 3_100 and sum(sizes) == len(text)
    assert len(pieces.inputFiles()) >= 8  # as many tasks wrote them
    assert bag(long_texts.term_info(corpus, 3_000)) == bag(terms.term_info(corpus))
    assert bag(long_texts.ngram_counts(corpus, 3, 3_000)) == bag(ngrams.ngram_counts(corpus, 3))


@pytest.mark.parametrize(("n", "block"), [(2, 1), (2, 100_000), (3, 1), (3, 2), (3, 10)])
def test_blocks_with_a_halo_give_the_whole_windows(corpus, n, block):
    one = corpus.dropDuplicates(["document"])
    got = ngrams.ngram_rows_from_tokens(tokens.tokens(one), n, block)
    assert bag(got) == bag(ngrams.ngram_rows(one, n))


def test_no_window_holds_a_long_document(spark):
    text = "a b c d " * 20_000
    corpus = spark.createDataFrame([(0, text)] + [(i, "x y z " * 30) for i in range(1, 900)], "document long, text string")
    rows = tokens.tokens(corpus)
    half = rows.where("document = 0").count()
    assert half > 0.45 * rows.count()
    grams = ngrams.ngram_rows_from_tokens(rows, 3, 1000)
    plan = grams._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(document" in plan and "block" in plan.split("hashpartitioning(document")[1].split(")")[0]
    assert grams.count() == ngrams.ngram_rows(corpus, 3).count()
