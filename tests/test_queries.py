import os

import pytest

from folioflow import queries
from tests.compare import FOLDER, differences

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_agrees_with_sql(spark, name):
    assert differences(spark, queries.QUERIES[name], queries.SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, FOLDER).count() > 0


def test_flagship(spark):
    rows = queries.flagship(spark, FOLDER).collect()
    assert rows and all(r.segments > 0 for r in rows)


def test_scans_are_pruned_and_joins_have_keys(spark):
    plan = queries.QUERIES["sentence_stats"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "protected_spans" not in plan and "unrepaired_text" not in plan
    for name in ("scope_link_overlap", "chunk_sources", "review_inventory", "ordered_merge_check"):
        plan = queries.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name
