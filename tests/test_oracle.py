"""Every registered query equals its DuckDB twin on the sf0.001 tables."""

import os

import pytest

from tests.oracle_harness import compare, duck

BASE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(BASE), reason="driver test data not present")


def _names():
    from corpusterms.plans.oracle import ORACLE

    return sorted(ORACLE)


@pytest.fixture(scope="module")
def con():
    return duck(BASE)


@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, BASE, name, con)
    assert r["columns_match"], r
    assert r["spark_rows"] == r["oracle_rows"], r
    assert r["values_match"], r


def test_every_query_has_an_oracle():
    import __spark_entry__ as E
    from corpusterms.plans.catalog import QUERIES
    from corpusterms.plans.oracle import ORACLE

    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql())


def test_no_registered_plan_deals_the_corpus_anew(spark):
    from corpusterms.plans.catalog import QUERIES

    for name, query in QUERIES.items():
        plan = query(spark, BASE)._jdf.queryExecution().executedPlan().toString()
        assert "RoundRobinPartitioning" not in plan, name


def test_entry_runs(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.columns == ["maxtfidf", "meantfidf", "mintfidf", "lower"]
    assert df.count() > 0
