"""Every query of the subpackage on the smallest tables, next to its SQL where there is one."""

import os

import pytest

from pairloom.llm import queries as q

from ..compare import compare, duck

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_query(spark, con, name):
    n, same, why = compare(spark, con, q.queries()[name], q.oracle_sql().get(name), SF)
    assert same is not False, why
    assert n >= 0


def test_found_columns(spark):
    want = {
        "p2_found": ["low_row_index", "high_row_index"], "p3_found": ["system_type", "label"], "p5_found": ["first_protein_id"],
        "p6_found": ["first_row_index", "copy_row_index"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id"],
    }
    for name, columns in want.items():
        assert q.queries()[name](spark, SF).columns == columns
