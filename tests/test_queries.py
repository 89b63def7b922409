"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as contract
from workload import all_queries
from workload.check import compare, connect

SF_DIR = "/root/testdata/sf0.001"
OWN, ORACLES = all_queries()
QUERIES = {name: query for name, query in contract.queries().items() if name in OWN}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_contract(spark):
    assert set(ORACLES) <= set(QUERIES) == set(OWN)
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(QUERIES) - set(ORACLES) == {"bootstrap_cells"}
    assert contract.entry(spark).count() == 18


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    if name in ORACLES:
        assert compare(df, duck, ORACLES[name]) == ""
    else:
        assert df.count() > 0
