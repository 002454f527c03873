import os

import pytest

from folioflow.llm import queries
from tests.compare import FOLDER, differences

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")

COLUMNS = {
    "p1_found": "origin item_key start_pos end_pos", "p2_found": "block_key defect", "p3_found": "origin item_key boundary", "p4_found": "origin item_key markup structure",
    "p5_found": "issue_key", "p6_found": "doc_id item_id", "p7_found": "source outcome", "p8_found": "doc_id",
}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_agrees_with_sql(spark, name):
    assert differences(spark, queries.QUERIES[name], queries.SQL[name]) == []


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_columns_and_distinct_rows(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    if name in COLUMNS:
        assert sorted(df.columns) == sorted(COLUMNS[name].split())
    rows = df.collect()
    if name.endswith("_found"):
        assert rows and len(set(rows)) == len(rows)
