"""What a batch computes and writes: compiled rows, no dictionary of n-grams, a short cache."""

import glob

import pyarrow.parquet as pq

from corpusterms.operators import ngrams, terms
from corpusterms.streaming import ingest

ROWS = [(1, "Aba aba-aba, ABA satu Satu dua {| x } tiga"), (2, ""), (3, None), (4, "... !"), (5, "satu dua tigaé satu dua tiga")]


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rows_are_built_without_lambdas(spark):
    docs = spark.createDataFrame(ROWS, "document long, text string")
    for n in (2, 3):
        assert "lambda" not in _plan(ngrams.ngram_rows(docs, n))
    assert "transform(" not in _plan(terms.term_stats(docs))


def test_rows_are_those_of_the_nested_form(spark):
    docs = spark.createDataFrame(ROWS, "document long, text string")
    flat = terms.term_stats(docs)
    nested = terms.term_stats(terms.doc_terms(docs))
    assert flat.schema.simpleString() == nested.schema.simpleString()
    assert sorted(flat.collect()) == sorted(nested.collect())
    for n in (2, 3):
        bag = ngrams.ngram_rows(docs, n).groupBy("document", "term").count().collect()
        counts = ngrams.ngram_counts(docs, n).select("document", "term", "occurence").collect()
        assert sorted(map(tuple, bag)) == sorted(map(tuple, counts))
    two = {(r.document, r.term, r.lower1, r.lower2) for r in ngrams.ngram_rows(docs, 2).collect()}
    assert (1, "ABA satu", "aba", "satu") in two and (5, "dua tiga", "dua", "tiga") in two
    assert not any(r[1].startswith("dua tiga ") or "x" in r[1] for r in two)


def test_stored_ngrams_have_no_dictionary(spark, tmp_path):
    store = str(tmp_path / "store")
    ingest.ingest_batch(spark, spark.createDataFrame(ROWS, "document long, text string"), store)
    for name in ("ngram_two", "ngram_three"):
        files = glob.glob(f"{store}/{name}/run_id=*/batch_id=*/*.parquet")
        assert files
        for f in files:
            meta = pq.ParquetFile(f).metadata
            for g in range(meta.num_row_groups):
                columns = {c.path_in_schema: c for c in (meta.row_group(g).column(i) for i in range(meta.num_columns))}
                assert not any("DICTIONARY" in e for e in columns["term"].encodings)
    assert {r.document: r.term_count for r in ingest.stored_tables(spark, store)["doc_info"].collect()} == {1: 6, 2: 0, 3: 0, 4: 0, 5: 3}
