"""chunk_build_all: numbered lines meet the facts of their jobs where they lie, and are not written or dealt a second time."""

import os
import re

import pytest

from skein.plans import loads
from skein.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_notes_of_lines_travel_once(spark, monkeypatch):
    names, keep = [], loads.kept
    monkeypatch.setattr(loads, "kept", lambda df, name: names.append(name) or keep(df, name))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES["chunk_build_all"](spark, SF)._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(names) == ["forms", "materials"]
    depth = [re.search(r"[A-Za-z]", line).start() if re.search(r"[A-Za-z]", line) else 0 for line in plan]
    (at,) = [i for i, line in enumerate(plan) if "Window [row_number" in line]
    above, least = [], depth[at]
    for i in range(at - 1, -1, -1):
        if depth[i] < least:
            above, least = [*above, plan[i]], depth[i]
    join = next(i for i, line in enumerate(above) if "SortMergeJoin" in line)
    assert not any("Exchange" in line for line in above[:join])
