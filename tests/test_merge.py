"""Copy-on-write merges against a dictionary."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.operators.merge import FILLED, OLD, Stored
from corvane.runtime import scratch_dir

SCHEMA = "k long, g string, a string, b int"


def stored(spark, **more):
    return Stored(spark, scratch_dir(spark, "stored"), ("k",), **more)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_merges_in_turn(spark):
    table, draw, held = stored(spark, buckets=8), random.Random(2), {}
    for batch in range(4):
        rows = [(draw.randrange(40), draw.choice(["x", None]), f"a{batch}", draw.choice([0, 5, None])) for _ in range(25)]
        df = spark.createDataFrame([(*r, at) for at, r in enumerate(rows)], f"{SCHEMA}, at int")
        final = {}
        for r in rows:
            final[r[0]] = r
        for k, r in final.items():
            if r[3] == 0 and batch:
                held.pop(k, None)
            elif k in held:
                g, a, b = held[k]
                held[k] = (r[1] or g, a, (b or 0) + (r[3] or 0))
            else:
                held[k] = r[1:]
        rules = {"g": FILLED, "a": OLD, "b": F.coalesce("o.b", F.lit(0)) + F.coalesce("n.b", F.lit(0))}
        newest = [F.desc("at")]
        if batch == 0:
            table.merge(df.groupBy("k").agg(F.max_by(F.struct("g", "a", "b"), "at").alias("s")).select("k", "s.*"), rules)
        else:
            table.merge(df, rules, newest, F.col("b") == 0)
        assert rows_of(table.read()) == sorted([(k, *v) for k, v in held.items()], key=str)
    assert table.version() == 4 and table.read(1).count() != table.read(4).count()
    table.vacuum()
    assert rows_of(table.read()) == sorted([(k, *v) for k, v in held.items()], key=str)


def test_only_touched_buckets_are_written(spark):
    table = stored(spark, buckets=16)
    table.merge(spark.range(200).selectExpr("id as k", "'g' as g", "'a' as a", "1 as b"))
    before = table.manifest(1)["buckets"]
    table.merge(spark.createDataFrame([(3, "h", "z", 2)], SCHEMA))
    after = table.manifest(2)["buckets"]
    assert sum(before[k] != after[k] for k in before) == 1 and table.read().where("k = 3").first()["b"] == 2 and table.read().count() == 200


def test_a_merge_that_fails_leaves_the_table(spark):
    table = stored(spark, buckets=4)
    table.merge(spark.createDataFrame([(1, "g", "a", 1)], SCHEMA))
    bad = spark.createDataFrame([(1, "g", "a", 2)], SCHEMA).withColumn("b", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        table.merge(bad)
    assert table.version() == 1 and rows_of(table.read()) == [(1, "g", "a", 1)]


def test_update_alone_and_columns_that_changes_lack(spark):
    table = stored(spark, buckets=4)
    table.merge(spark.createDataFrame([(1, "g", "a", 1), (2, "g", "a", 1)], SCHEMA))
    table.merge(spark.createDataFrame([(1, 7), (9, 7), (None, 7)], "k long, b int"), insert=False)
    assert rows_of(table.read()) == [(1, "g", "a", 7), (2, "g", "a", 1)]
    table.merge(spark.createDataFrame([(1, True), (2, True)], "k long, gone boolean"), delete=F.col("gone"))
    assert rows_of(table.read()) == []
    table.merge(spark.createDataFrame([(4, 4)], "k long, b int"))
    assert rows_of(table.read()) == [(4, None, None, 4)]


def test_a_second_writer_of_a_version_fails(spark):
    table = stored(spark, buckets=4)
    table.merge(spark.createDataFrame([(1, "g", "a", 1)], SCHEMA))
    with pytest.raises(Exception, match="already exists|FileAlreadyExists"):
        table._commit(1, {})
