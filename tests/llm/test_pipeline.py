import corpus_pipeline
from corpusterms.llm.queries import ORACLE, QUERIES

from .conftest import SF
from .test_bpe_and_packing import check_packing
from .test_exact_dedup import brute as exact
from .test_ngram_join import brute as near


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    # Every text here has letters of a labelled language, so all pass stage 1.
    keep = {d for d, k, *_ in exact(rows) if d == k}
    rows = [r for r in rows if r[0] in keep]
    keep = {c for _, _, c, _ in near(rows)}
    rows = [r for r in rows if r[0] in keep]
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == keep
    check_packing(got, rows)


def test_stage_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert set(ORACLE) <= set(QUERIES)


def test_sql_twins(spark):
    from tests.oracle_harness import compare

    for name in ORACLE:
        r = compare(spark, SF, name)
        assert r["values_match"], r
