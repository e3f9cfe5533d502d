"""The corpus queries against their SQL on the given tables."""

import os

import oracle
import pytest

from skein.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    assert oracle.differences(QUERIES[name](spark, SF), oracle.connect(SF), SQL[name]) == []
