"""Whole neighbour queries when the index has many cells and no task may hold many queries or vectors."""

import harness
import pytest
from conftest import SF

from corvane.operators import knn
from corvane.operators import vector as V
from corvane.plans import vector_plans as plans

ROOM, CALLERS = 150, 25


@pytest.mark.parametrize("name", ["v03_query_stats", "v07_match_counts", "v27_p06_confidence", "j12_inner_of_two_lists"])
def test_tasks_hold_bounded_groups_and_give_the_rows_of_sql(spark, con, monkeypatch, name):
    search, most = knn.search, (3 * CALLERS, 2 * ROOM)  # rows are dealt by hash, so groups vary

    def bounded(q, x, k):
        assert len(q) <= most[0] and len(x) <= most[1], f"{len(q)} queries meet {len(x)} vectors"
        return search(q, x, k)

    monkeypatch.setattr(knn, "search", bounded)
    monkeypatch.setattr(knn, "FOUND", 100 * CALLERS)
    monkeypatch.setattr(V, "BLOCK_BYTES", 8 * 32 * ROOM)
    assert harness.compare(spark, con, SF, plans.QUERIES[name], plans.ORACLE_SQL[name]) == ""
