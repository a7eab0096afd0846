"""A feed that is killed, resumed, stopped and begun anew gives the rows of one batch."""

import pytest
from pyspark.sql import functions as F

from corvane.runtime import scratch_dir
from corvane.streaming.changefeed import Feed


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def arrivals(spark):
    folder = scratch_dir(spark, "arrivals")
    rows = spark.range(600).select((F.col("id") * 7 % 23).alias("k"), F.col("id").alias("at"), (F.col("id") * 3).alias("v"))
    for part in range(3):
        rows.where(F.col("at") % 3 == part).coalesce(1).write.mode("append").parquet(folder)
    want = sorted(map(tuple, rows.groupBy("k").agg(F.max("at"), F.max("v")).collect()))
    return folder, rows.schema, want


def feed(spark, arrivals, home, **more):
    return Feed(spark, arrivals[0], arrivals[1], ("k",), "at", ("v",), home, **more)


@pytest.mark.parametrize("lost", [0, 1, 2])
def test_killed_between_the_table_and_the_commit(spark, arrivals, lost):
    home = scratch_dir(spark, "feed")

    def die(number):
        if number == lost:
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        feed(spark, arrivals, home).run(on_batch=die)
    assert feed(spark, arrivals, home).batches()[-1] == lost
    seen = []
    again = feed(spark, arrivals, home)
    again.run(on_batch=seen.append)
    assert seen == list(range(lost, 3))  # the lost batch is run again, those before it are not
    assert rows_of(again.read()) == arrivals[2]


def test_what_has_been_read_is_not_read_again(spark, arrivals):
    f = feed(spark, arrivals, scratch_dir(spark, "feed"))
    assert sum(p["numInputRows"] for p in f.run()) == 600
    assert sum(p["numInputRows"] for p in f.run()) == 0
    spark.createDataFrame([(5, 10_000, -1)], "k long, at long, v long").write.mode("append").parquet(arrivals[0])
    told = []
    assert sum(p["numInputRows"] for p in f.run(on_progress=told.append)) == 1 and len(told) >= 1
    assert (5, 10_000, -1) in rows_of(f.read()) and len(f.batches()) == 2


def test_other_logic_begins_anew(spark, arrivals):
    home = scratch_dir(spark, "feed")
    old = feed(spark, arrivals, home)
    old.run()
    new = feed(spark, arrivals, home, logic=2, change=lambda rows: rows.where("at < 300"))
    assert sum(p["numInputRows"] for p in new.run()) == 600
    assert max(r["at"] for r in new.read().collect()) < 300 and old.batches() == []


def test_stopped_and_resumed(spark, arrivals):
    home, seen = scratch_dir(spark, "feed"), []
    feed(spark, arrivals, home).run(on_batch=seen.append, stop_when=lambda: len(seen) >= 1)
    f = feed(spark, arrivals, home)
    f.run()
    assert rows_of(f.read()) == arrivals[2]


def test_nothing_has_arrived(spark):
    folder = scratch_dir(spark, "arrivals")
    schema = spark.createDataFrame([], "k long, at long, v long").schema
    spark.createDataFrame([], schema).write.parquet(folder)
    f = Feed(spark, folder, schema, ("k",), "at", ("v",), scratch_dir(spark, "feed"))
    f.run()
    assert f.read().collect() == []
