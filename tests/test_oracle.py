"""Every registered query against its SQL at the smallest scale; a query without SQL must give a stable schema and rows."""

import os

import pytest

import oracle
from skein.plans.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in SQL:
        assert oracle.differences(df, con, SQL[name]) == []
    else:
        assert df.count() > 0


def test_registry():
    assert set(SQL) <= set(QUERIES)
