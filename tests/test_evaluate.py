"""Comparison of sets by item."""

from corvane import runtime
from corvane.operators import evaluate as E

PAIRS = "item_id long, entity long"


def test_sets_are_compared_whatever_nulls_and_repeats(spark):
    expected = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 5), (3, None), (None, 4)], PAIRS)
    found = spark.createDataFrame([(1, 2), (1, 2), (1, 3), (3, None), (4, 1), (None, 4)], PAIRS)
    got = {r["item_id"]: (r["tp"], r["fn"], r["fp"]) for r in E.compare(expected, found, 6).collect()}
    assert got == {1: (1, 1, 1), 2: (0, 1, 0), 3: (0, 1, 1), 4: (0, 0, 1), None: (0, 1, 1)}


def test_tasks_hold_a_bounded_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(runtime, "ROWS_A_TASK", 50)
    rows = spark.range(1_000).selectExpr("id as item_id", "id % 7 as entity")
    out = E.compare(rows, rows, 1_000)
    assert out.count() == 1_000
    assert out.rdd.getNumPartitions() == 40  # of 2,000 rows, which were one task
