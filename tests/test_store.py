"""Table replacement, upserts and streams."""

from corvane.operators import store as S
from corvane.runtime import scratch_dir
from pyspark.sql import functions as F


def test_swap_replaces_a_table_that_is_being_read(spark):
    path = scratch_dir(spark, "swap")
    S.swap_in(spark, spark.range(3), path)
    S.swap_in(spark, spark.read.parquet(path).union(spark.range(5, 6)), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [0, 1, 2, 5]


def test_upsert_keeps_old_where_new_is_null(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, x string, y int")
    new = spark.createDataFrame([(2, None, 9), (3, "c", None)], "k int, x string, y int")
    assert sorted(map(tuple, S.upsert_non_null(old, new, ["k"]).collect())) == [(1, "a", 1), (2, "b", 9), (3, "c", None)]


def test_insert_if_absent_takes_the_first(spark):
    old = spark.createDataFrame([("t", 1, 10)], "type string, target int, id int")
    new = spark.createDataFrame([("t", 1, 11), ("t", 2, 13), ("t", 2, 12)], "type string, target int, id int")
    assert sorted(map(tuple, S.insert_if_absent(old, new, ["type", "target"], F.col("id")).collect())) == [("t", 1, 10), ("t", 2, 12)]


def test_second_request_of_a_type_is_rejected(spark):
    jobs = spark.createDataFrame([("a", "running"), ("b", "failed")], "type string, status string")
    asked = spark.createDataFrame([("a", 1), ("b", 3), ("b", 2), ("c", 4)], "type string, id int")
    assert sorted(map(tuple, S.submit(jobs, asked).collect())) == [("a", 1, "rejected"), ("b", 2, "queued"), ("b", 3, "rejected"), ("c", 4, "queued")]
