"""Impact-ordered postings: equal to ranking all of a word's rows, reading few."""

import pytest

from corpusterms.operators import postings, scoring, terms


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    # ``stop`` in most documents (many of equal frequency), ``every`` in all, ``rare`` in one.
    texts = ["every " + "stop " * (1 + i % 7) + " ".join(f"w{i}x{j}" for j in range(i % 23)) for i in range(600)]
    texts += ["every"] * 300 + ["every rare Stop stop"]
    corpus = spark.createDataFrame(list(enumerate(texts)), "document long, text string").repartition(3)
    path = str(tmp_path_factory.mktemp("postings"))
    postings.write_postings(terms.term_info(corpus), path, block=16)
    return corpus, path


@pytest.mark.parametrize("word", ["stop", "STOP", "rare", "every", "none", "w5x3"])
def test_equal_to_ranking_all(spark, stored, word):
    corpus, path = stored
    registry = terms.doc_info(corpus)
    for k in (1, 10, 50):
        got = [tuple(r) for r in postings.top_postings(spark, path, word, registry, k).collect()]
        assert got == [tuple(r) for r in scoring.rank_word(corpus, word, k=k).collect()]


def test_a_stop_word_needs_a_bounded_number_of_blocks(spark, stored):
    corpus, path = stored
    blocks = spark.read.parquet(f"{path}/blocks")
    all_blocks = blocks.where("lower = 'stop'").count()
    total, chosen = postings.chosen_blocks(blocks, "stop", 901, 10)
    assert total == 602 and all_blocks >= 602 // 16 and len(chosen) <= 2
    plan = postings.top_postings(spark, path, "stop", terms.doc_info(corpus))
    assert "EqualTo(lower,stop)" in plan._jdf.queryExecution().executedPlan().toString()


def test_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], "document long, text string")
    postings.write_postings(terms.term_info(empty), str(tmp_path))
    assert postings.top_postings(spark, str(tmp_path), "x", terms.doc_info(empty)).collect() == []
