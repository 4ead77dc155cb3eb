"""Physical plan properties the operators are designed for."""

import re

import pytest

from corpusterms.operators import ngrams, scoring, terms


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _corpus(spark):
    rows = [(f"d{i}", f"Kata{i % 7} kata, alat muzik{i % 3} saluang-saluang. The the") for i in range(64)]
    # Several input partitions, as a real scan has: no spreading needed.
    return spark.createDataFrame(rows, "document string, text string").repartition(4)


def _exchanges_above_input(plan):
    # The corpus itself is built by a repartition; count the others.
    return len(re.findall(r"Exchange (?!RoundRobinPartitioning)", plan))


def test_term_and_ngram_tables_do_not_shuffle(spark):
    c = _corpus(spark)
    for df in (terms.term_info(c), terms.doc_info(c), ngrams.ngram_rows(c, 2), ngrams.ngram_counts(c, 3)):
        assert _exchanges_above_input(_plan(df)) == 0, _plan(df)


@pytest.fixture
def stored_corpus(spark, tmp_path):
    path = str(tmp_path / "corpus")
    _corpus(spark).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("score", [scoring.tf_idf_summary, scoring.doc_frequency_total, scoring.tf_idf_series, scoring.top_terms])
def test_corpus_total_reuses_the_terms_exchange(spark, stored_corpus, score):
    df = score(stored_corpus)
    assert "Join" not in _plan(df)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    # The subquery's exchange on lower is the main query's (or the other way
    # round): the text is scanned once.
    assert "ReusedExchange" in plan, plan


def test_listing_splits_a_hot_word(spark):
    rows = [(i, "the the alat " + ("muzik " if i % 3 else "")) for i in range(60_000)]
    c = spark.createDataFrame(rows, "document long, text string").repartition(8)
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    }
    before = {k: spark.conf.get(k, None) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        df = scoring.tf_idf(c)
        assert df.count() > 0 and not spark.sparkContext._jsc.getPersistentRDDs()
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan, plan
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_stored_word_lookup_pushes_filter(spark, tmp_path):
    c = _corpus(spark)
    path = str(tmp_path / "ti")
    terms.term_stats(c).sortWithinPartitions("lower").write.parquet(path)
    st = spark.read.parquet(path)
    plan = _plan(terms.term_postings(st, "Kata1"))
    assert "EqualTo(lower,kata1)" in plan, plan
    assert "Exchange" not in plan, plan
    assert len(terms.term_postings(st, "Kata1").collect()) > 0
