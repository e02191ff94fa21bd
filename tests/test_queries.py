"""Every query of the core next to its SQL on the smallest tables."""

import os

import pytest

from pairloom.plans import corpus_queries, pair_queries, survey_queries

from .compare import compare, duck

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = corpus_queries.queries() | pair_queries.queries() | survey_queries.queries()
SQL = corpus_queries.oracle_sql() | pair_queries.oracle_sql() | survey_queries.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name == "best_c3_split":
        pytest.skip("the smallest table has too few groups")
    n, same, why = compare(spark, con, QUERIES[name], SQL.get(name), SF)
    assert same is not False, why
    assert n >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns
    assert set(e.oracle_sql()) <= set(e.queries())
