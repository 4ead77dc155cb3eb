"""As-built term tables on the fixture documents d1 and d2."""

import math

import pytest
from pyspark.sql import functions as F

from corpusterms.operators import ngrams, registry, scoring, terms

D1 = ("d1", "Saluang saluang, alat muzik. Saluang")
D2 = ("d2", "…")


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_term_info(corpus):
    c = corpus(D1, D2)
    ti = terms.term_info(c)
    assert rows(ti, "document", "term", "lower", "occurence") == [
        ("d1", "Saluang", "saluang", 2),
        ("d1", "alat", "alat", 1),
        ("d1", "muzik", "muzik", 1),
        ("d1", "saluang", "saluang", 1),
    ]
    freq = {r.term: r.frequency for r in ti.collect()}
    assert freq == {"Saluang": 0.5, "saluang": 0.25, "alat": 0.25, "muzik": 0.25}


def test_doc_info_keeps_empty_documents(corpus):
    assert rows(terms.doc_info(corpus(D1, D2)), "document", "term_count") == [("d1", 4), ("d2", 0)]


def test_term_doc_info_counts_case_variants(corpus):
    assert rows(terms.term_doc_info(corpus(D1, D2)), "term", "doc_count") == [
        ("alat", 1),
        ("muzik", 1),
        ("saluang", 2),
    ]
    assert rows(scoring.doc_frequency(corpus(D1, D2)), "lower", "docfreq") == [
        ("alat", 1),
        ("muzik", 1),
        ("saluang", 1),
    ]


def test_ngrams(corpus):
    c = corpus(D1, D2)
    assert rows(ngrams.ngram_rows(c, 2), "term", "lower1", "lower2") == [
        ("Saluang saluang", "saluang", "saluang"),
        ("alat muzik", "alat", "muzik"),
    ]
    assert ngrams.ngram_rows(c, 3).count() == 0
    assert ngrams.ngram_counts(c, 3).count() == 0


def test_ngram_bag_sums_equal_counts(corpus):
    c = corpus(("a", "x y x y x y. x y"), ("b", "p q r p q r"))
    for n in (2, 3):
        bag = ngrams.ngram_rows(c, n).agg(F.sum("occurence")).first()[0]
        grouped = ngrams.ngram_counts(c, n)
        assert grouped.agg(F.sum("occurence")).first()[0] == bag
    assert rows(ngrams.ngram_counts(c, 2).where("document = 'a'"), "term", "occurence") == [
        ("x y", 4),
        ("y x", 2),
    ]


def test_token_total_tf_and_counts(corpus):
    c = corpus(D1, D2)
    tf = {r.term: r.frequency for r in scoring.term_frequency(c).collect()}
    assert tf == {"Saluang": 2 / 5, "saluang": 1 / 5, "alat": 1 / 5, "muzik": 1 / 5}
    cc = scoring.corpus_counts(c).first()
    assert (cc.documents, cc.unique_tokens, cc.token_total) == (1, 3, 5)
    assert registry.registry_count(terms.doc_info(c)).first().documents == 2


def test_word_idf(corpus):
    c = corpus(D1, D2)
    r = scoring.word_idf(c, "Saluang").first()
    assert (r.documents, r.postings) == (2, 2)
    assert math.isclose(r.idf, math.log10(2 / 3))
    r = scoring.word_idf(c, "tiada").first()
    assert math.isclose(r.idf, math.log10(2))


def test_rank_word_order(corpus):
    c = corpus(D1, D2, ("d3", "saluang alat alat alat"))
    got = rows(scoring.rank_word(c, "saluang"), "document", "term")
    assert len(got) == 3
    ranked = scoring.rank_word(c, "saluang").collect()
    assert [r.tfidf for r in ranked] == sorted([r.tfidf for r in ranked], reverse=True)


def test_summary_equals_join_form(corpus):
    """The join-free summary equals max/avg/min over joined term rows."""
    c = corpus(D1, D2, ("d3", "saluang alat alat The the THE"), ("d4", "the end"))
    for mode in ("log10", "ratio", "series"):
        s = {r.lower: r for r in scoring.tf_idf_summary(c, idf_mode=mode).collect()}
        ti = scoring.tf_idf(c).collect()
        n = ti[0].doctotal
        from corpusterms.functions import scores

        by = {}
        for r in ti:
            x = n / r.docfreq
            idf = {"log10": math.log10(n / (1 + r.docfreq)), "ratio": x, "series": 2 * (x + x**3 / 3 + x**5 / 5 + x**7 / 7)}[mode]
            by.setdefault(r.lower, []).append(r.tf * idf)
        for lower, vals in by.items():
            assert math.isclose(s[lower].maxtfidf, max(vals), rel_tol=1e-12, abs_tol=1e-15)
            assert math.isclose(s[lower].mintfidf, min(vals), rel_tol=1e-12, abs_tol=1e-15)
            assert math.isclose(s[lower].meantfidf, sum(vals) / len(vals), rel_tol=1e-9, abs_tol=1e-15)


def test_doc_info_equals_term_rows(corpus):
    c = corpus(("a", "x X y, y-z y-z"), ("b", "tiada"), ("c", ""))
    di = dict(rows(terms.doc_info(c), "document", "term_count"))
    per = dict(rows(terms.term_info(c).groupBy("document").count(), "document", "count"))
    assert di == {"a": 4, "b": 1, "c": 0}
    assert all(di[d] == per.get(d, 0) for d in di)


def test_enrich_plain_term_info(corpus):
    c = corpus(D1, ("d3", "saluang alat alat The the THE"))
    plain = terms.term_info(c)
    a = sorted(tuple(r) for r in scoring.tf_idf_summary(c).collect())
    b = sorted(tuple(r) for r in scoring.tf_idf_summary(plain).collect())
    assert [x[3] for x in a] == [x[3] for x in b]
    for x, y in zip(a, b):
        assert all(math.isclose(u, v, rel_tol=1e-12) for u, v in zip(x[:3], y[:3]))


def test_summary_stddev(corpus):
    import statistics

    c = corpus(D1, D2, ("d3", "saluang alat alat The the THE"), ("d4", "the end"))
    s = {r.lower: r for r in scoring.tf_idf_summary(c, idf_mode="ratio", with_stddev=True).collect()}
    ti = scoring.tf_idf(c).collect()
    vals = [r.tf * r.power_of_idf for r in ti if r.lower == "the"]
    assert math.isclose(s["the"].sdtfidf, statistics.stdev(vals), rel_tol=1e-9)
    assert s["end"].sdtfidf is None  # one row: no sample deviation


def test_word_prefilter_is_exact(corpus):
    c = corpus(D1, D2, ("d3", "Kata-kata SALUANG"), ("d4", "tiada"))
    got = sorted((r.document, r.term) for r in terms.term_postings(c, "saluang").collect())
    assert got == [("d1", "Saluang"), ("d1", "saluang"), ("d3", "SALUANG")]
    r = scoring.word_idf(c, "saluang").first()
    assert (r.documents, r.postings) == (4, 3)


def test_rank_report_formats_scores(corpus):
    c = corpus(D1, D2)
    lines = [r.line for r in scoring.rank_report(scoring.rank_word(c, "alat")).collect()]
    assert lines == ["TFIDF is 0.00000 for d1 alat"]  # idf = log10(2 / (1 + 1)) = 0


def test_summary_modes(corpus):
    """vocab TF, row-counted DF and registry N against a direct computation."""
    c = corpus(D1, D2, ("d3", "saluang alat alat The the THE"), ("d4", "the end"))
    s = {
        r.lower: r
        for r in scoring.tf_idf_summary(
            c, idf_mode="log10", tf_mode="vocab", df_mode="rows", n_mode="registry"
        ).collect()
    }
    ti = terms.term_info(c).collect()
    n = 4  # registry: every document, d2 without terms included
    rows_per = {}
    for r in ti:
        rows_per.setdefault(r.lower, []).append(r.frequency)
    for lower, freqs in rows_per.items():
        idf = math.log10(n / (1 + len(freqs)))
        vals = [f * idf for f in freqs]
        assert math.isclose(s[lower].maxtfidf, max(vals), rel_tol=1e-12, abs_tol=1e-15)
        assert math.isclose(s[lower].mintfidf, min(vals), rel_tol=1e-12, abs_tol=1e-15)
        assert math.isclose(s[lower].meantfidf, sum(vals) / len(vals), rel_tol=1e-9, abs_tol=1e-15)


def test_window_ngrams_equal_array_ngrams(corpus):
    from corpusterms.operators import tokens as T

    c = corpus(D1, D2, ("d3", "a b c. d e f g, h"), ("d4", "x-y z"))
    for n in (2, 3):
        a = rows(ngrams.ngram_rows(c, n), "document", "term")
        b = rows(ngrams.ngram_rows_from_tokens(T.tokens(c), n), "document", "term")
        assert a == b
