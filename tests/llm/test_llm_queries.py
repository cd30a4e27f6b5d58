import os

import pytest

from ledgerloom.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
COLUMNS = {
    "p1_found": [("line_id", "string"), ("service", "string")],
    "p5_found": [("qa_id", "bigint"), ("defect", "string")],
    "p6_found": [("doc_id", "bigint"), ("item_id", "bigint")],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs(spark, name):
    got = QUERIES[name](spark, DATA)
    assert got.count() > 0
    if name in COLUMNS:
        assert got.dtypes == COLUMNS[name]


@pytest.mark.parametrize("name", ["p1_found", "p5_found", "p7_shares", "p8_pieces"])
def test_nothing_changes_beyond_the_broadcast_bound(spark, monkeypatch, name):
    from ledgerloom.operators import bounded

    want = sorted(map(str, QUERIES[name](spark, DATA).collect()))
    monkeypatch.setattr(bounded, "is_bounded", lambda *a: False)
    assert sorted(map(str, QUERIES[name](spark, DATA).collect())) == want
