"""Blocking in units of bounded size, and the Hamming join, against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from corvane import runtime
from corvane.operators import blocking as B


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def pairs_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("part, hot", [(512, 10_000), (7, 10_000), (7, 3), (1, 10_000)])
def test_self_block_equals_all_pairs(spark, monkeypatch, part, hot):
    monkeypatch.setattr(B, "PART", part)
    monkeypatch.setattr(B, "HOT", hot)
    draw = random.Random(1)
    rows = [(draw.randrange(120), draw.choice("aaaab"), draw.choice([1, 1, 2, None])) for _ in range(300)] + [(None, "a", 1)]
    df = spark.createDataFrame(rows, "id long, k string, n int").withColumn("key", F.lit("mine"))
    held = {}
    for i, k, n in rows:
        if None not in (i, n):
            held.setdefault((k, n), set()).add(i)
    assert pairs_of(B.self_block(df, ["k", "n"])) == sorted({(a, b) for s in held.values() for a in s for b in s if a < b})
    assert pairs_of(B.self_block(df.limit(0), ["k", "n"])) == []


def test_no_task_gets_a_hot_key(spark):
    rows = spark.range(40_000).select("id", F.when(F.col("id") % 10 == 0, 0).otherwise(F.col("id") % 9_000).alias("k"))
    for side in B.units(B.keyed(rows, ["k"])):
        dealt = side.repartition(64, "key", "u", "v").groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"))
        most, mean = dealt.agg(F.max("n"), F.sum("n") / 64).first()
        assert most < 5 * mean
    left, right = B.units(B.keyed(rows, ["k"]))
    assert max(r["n"] for r in left.groupBy("key", "u", "v").agg(F.count("*").alias("n")).collect()) < 2 * B.PART


def hashes(draw, n):
    base = [draw.getrandbits(64) for _ in range(n)]
    near = [h ^ sum(1 << b for b in draw.sample(range(64), draw.randrange(13))) for h in base]
    return base + near + base[:5] * 3


@pytest.mark.parametrize("limit", [0, 1, 3, 10, 13])
def test_hamming_join_equals_all_pairs(spark, limit):
    hs = hashes(random.Random(limit), 80)
    df = spark.createDataFrame([*enumerate(map(signed, hs)), (999, None), (None, 5)], "id long, h long")
    want = [(i, j, (hs[i] ^ hs[j]).bit_count()) for i in range(len(hs)) for j in range(i + 1, len(hs)) if (hs[i] ^ hs[j]).bit_count() <= limit]
    assert pairs_of(B.hamming_join(df, limit)) == want


@pytest.mark.parametrize("count", [3, 4, 6, 7, 11])
def test_any_number_of_bands_meets_all(spark, count):
    draw = random.Random(count)
    hs = sorted({h & 0xFFFF_0000_FFFF_00FF | 0x3C00 for h in hashes(draw, 60)})  # some bits never change
    spare = 10 - count + 1
    found = [B.Band(tuple(range(64))[k::count], spare // count + (k < spare % count)) for k in range(count)]
    df = spark.createDataFrame([(signed(h),) for h in hs], "h long")
    got = {frozenset(r) for r in B.hamming_candidates(df, found).distinct().collect()}
    assert got >= {frozenset((signed(a), signed(b))) for a in hs for b in hs if a < b and (a ^ b).bit_count() <= 10}


def test_bands_widen_as_hashes_grow():
    widths = [max(len(b.bits) for b in B.bands(n, [n // 2] * 64, 10)) for n in (10**3, 10**6, 10**9)]
    assert widths == sorted(widths) and widths[0] < widths[-1]


def test_filed_rows_do_not_pass_the_driver(spark):
    """However small the hashes and keys look, what they are filed under is not broadcast."""
    hs = spark.createDataFrame([(signed(h),) for h in hashes(random.Random(2), 60)], "h long").distinct()
    plans = [B.hamming_candidates(hs, B.bands(10**6, [5 * 10**5] * 64, 10)), B.self_block(spark.range(50).withColumn("k", F.lit(1)), ["k"])]
    for df in plans:
        df.collect()
        said = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" in said and "Broadcast" not in said


def test_pairs_are_made_in_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(runtime, "ROWS_A_TASK", 50)
    out = B.self_block(spark.range(1_000).selectExpr("id", "id div 2 as k"), ["k"])
    assert out.count() == 500
    assert out.rdd.getNumPartitions() == 20  # of 1,000 rows filed, which were one task


def test_pairs_and_what_they_meet_do_not_pass_the_driver(spark):
    """However well pairs, items and prints compress, their joins are by a shuffle."""
    from corvane.operators import pairs as P
    from corvane.plans import pair_plans

    cand = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    prints = spark.createDataFrame([(i, e, 0.5) for i in (1, 2, 3) for e in "xy"], "id long, entity string, proportion double")
    hs = spark.createDataFrame([(k, h) for k, h in enumerate((1, 3, 1 << 40, 1))], "id long, h long")
    sf = "/root/testdata/sf0.001"
    plans = [P.signature_scores(cand, prints), B.hamming_join(hs), pair_plans.by_meta(spark, sf), pair_plans.meta_scores(spark, sf, cand.withColumn("source", F.lit("hash")))]
    for df in plans:
        df.collect()
        said = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" in said and "Broadcast" not in said


@pytest.mark.parametrize("name", ["b03_shared_id_test", "b04_b05_jaccard_and_days", "b07_face_signature", "b09_hash_score", "b10_pair_confidence", "b12_findings"])
def test_pair_queries_broadcast_nothing(spark, name):
    """Whole queries, with the candidates, items and prints that they make themselves."""
    from corvane.plans import pair_plans

    df = pair_plans.QUERIES[name](spark, "/root/testdata/sf0.001")
    df.collect()
    said = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" in said and "Broadcast" not in said
