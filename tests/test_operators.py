"""Operators against plain restatements, and their behaviour at the edges."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from corvane.functions import kernels as K
from corvane.operators import diff as D
from corvane.operators import pairs as P
from corvane.operators import vector as V
from corvane.operators import voting as T


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(n) for n, c in cols.items())).first().asDict()


def test_zero_vector_is_at_distance_one(spark):
    z, a = F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(2.0))
    got = one(spark, zero=V.cosine_distance(z, a), same=F.round(V.cosine_distance(a, a), 9))
    assert got == {"zero": 1.0, "same": 0.0}


def test_nearest_is_exact(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    q = df.where("id < 40")
    got = V.nearest(q, df.where("id >= 40"), 7).toPandas().sort_values(["query_id", "rank"])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = np.argsort(1 - u[:40] @ u[40:].T, axis=1)[:, :7] + 40
    assert (got["cand_id"].to_numpy().reshape(40, 7) == want).all()


def test_query_blocks_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((60, 4)))], "id long, vec array<double>")
    whole = V.nearest(df, df, 3).orderBy("query_id", "rank").collect()
    monkeypatch.setattr(V, "BLOCK_BYTES", 8 * 4 * 25)
    assert V.nearest(df, df, 3).orderBy("query_id", "rank").collect() == whole


def test_health_order_of_rules(spark):
    cases = [(0.25, 0.0, 0.0, "healthy"), (0.05, 0.001, 0.2, "degenerate"), (0.05, 0.01, 0.01, "degenerate"), (0.15, 0.0001, 0.01, "degenerate"), (0.15, 0.01, 0.2, "healthy"), (None, None, None, "no_results")]
    df = spark.createDataFrame(cases, "a double, b double, c double, want string")
    assert df.select((V.health(F.col("a"), F.col("b"), F.col("c")) == F.col("want")).alias("ok")).where("not ok").count() == 0


def test_hamming_join_equals_all_pairs(spark):
    rng = random.Random(3)
    hs = [rng.getrandbits(64) for _ in range(60)]
    hs += [h ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for h in hs[:30]] + hs[:5]
    signed = [h - (1 << 64) if h >> 63 else h for h in hs]
    df = spark.createDataFrame(list(enumerate(signed)) + [(999, None)], "id long, h long")
    got = {tuple(r) for r in P.hamming_join(df, 10).collect()}
    assert got == {(i, j, (hs[i] ^ hs[j]).bit_count()) for i in range(len(hs)) for j in range(i + 1, len(hs)) if (hs[i] ^ hs[j]).bit_count() <= 10}


def test_bad_hex_is_null(spark):
    got = spark.createDataFrame([("zz",), ("",), ("ff",), ("1" * 17,)], "h string").select(P.hash_of_hex(F.col("h")).alias("v")).collect()
    assert [r.v for r in got] == [None, None, 255, None]


def test_days_accept_short_dates(spark):
    got = one(spark, a=P.days_between(F.lit("2024-1-5"), F.lit("2024-01-12")), b=P.days_between(F.lit("2024"), F.lit("2024-01-12")))
    assert got == {"a": 7, "b": None}


def test_confidence_tiers(spark):
    n = F.lit(None).cast("int")
    z = F.lit(0.0)
    got = one(
        spark, ids=P.pair_confidence(F.lit(True), n, z, z, z), none=P.pair_confidence(F.lit(False), n, z, z, z),
        strong=P.pair_confidence(F.lit(False), F.lit(2), P.hash_score(F.lit(2)), z, F.lit(60.0)), alone=P.pair_confidence(F.lit(False), F.lit(10), P.hash_score(F.lit(10)), z, z),
        both=P.pair_confidence(F.lit(False), n, z, F.lit(50.0), F.lit(40.0)),
    )
    assert got == {"ids": 100.0, "none": None, "strong": 77.0, "alone": 12.0, "both": 62.0}


def test_clusters_fold_in_order(spark):
    rows = [(1, f, f, v) for f, v in enumerate([[1.0, 0.0], [0.9, 0.1], [0.0, 1.0], [0.0, 0.0]])]
    got = T.cluster_faces(spark.createDataFrame(rows, "item_id long, frame long, face_id long, vec array<double>")).orderBy("face_id").collect()
    assert [r.cluster for r in got] == [0, 0, 1, 2]


def test_each_entity_is_taken_once(spark):
    rows = [(1, 0, 5, "a", 0.9, 1), (1, 0, 5, "b", 0.8, 2), (1, 1, 3, "a", 0.95, 1), (1, 1, 3, "c", 0.2, 2), (1, 2, 1, "a", 0.5, 1)]
    got = T.assign_greedily(spark.createDataFrame(rows, "item_id long, cluster int, size int, entity string, score double, rank int")).orderBy("cluster").collect()
    assert [r.entity for r in got] == ["a", "c", None]


def test_values_equal(spark):
    own = F.lit("Me")
    al = lambda *x: F.array(*map(F.lit, x))
    got = one(
        spark, empty=D.equal(F.lit(""), F.lit("0"), "exact"), case=D.equal(F.lit("BROWN"), F.lit("brown"), "text"), date=D.equal(F.lit("2001"), F.lit("2001-01-01T00:00"), "date"),
        alias=D.equal(al("ME", "http://X/"), al("http://x"), "aliases", own), not_alias=D.equal(al("a"), al("b"), "aliases", own), own_slash=D.equal(al("me/"), al("x"), "aliases", own),
    )
    assert got == {"empty": True, "case": True, "date": True, "alias": True, "not_alias": False, "own_slash": False}


def test_suppression_keeps_the_best(spark):
    rows = [(1, 1, 0.9, 0.0, 0.0, 10.0, 10.0), (1, 2, 0.8, 1.0, 1.0, 11.0, 11.0), (1, 3, 0.7, 50.0, 50.0, 60.0, 60.0)]
    got = K.suppress(spark.createDataFrame(rows, "image long, id long, score double, x1 double, y1 double, x2 double, y2 double")).collect()
    assert sorted(r.id for r in got) == [1, 3]


def test_grids_at_their_edges(spark):
    got = one(spark, none=K.even_grid(F.lit(0.0), 5), single=K.even_grid(F.lit(100.0), 1), burst=K.burst_grid(F.lit(0.0), 8, 4, 0.5), zones=F.size(K.weighted_grid(F.lit(600.0), 40)))
    assert got == {"none": [0.0], "single": [50.0], "burst": [0.0], "zones": 40}


def test_gaps_and_batches(spark):
    from corvane.sources import text as S

    df = spark.createDataFrame(pd.DataFrame({"k": [1, 2, 5, 9, 10]}))
    assert {tuple(r) for r in S.gaps(df, "k").collect()} == {(3, 4, 2), (6, 8, 3)}
    assert sorted(r.batch for r in S.batches(df, "k", 2).collect()) == [0, 0, 1, 1, 2]


def test_sizes_round_and_end_as_asked(spark):
    sizes = [0, 1, 1023, 1280, 1792, 1314, 5 << 19, (1 << 40) - 1, 1 << 40, 3 << 50, 5 << 60, None]
    df = spark.createDataFrame([(float(n) if n is not None else None,) for n in sizes], "n double")

    def want(n, units):
        k = max(k for k in range(len(units)) if k == 0 or n >= 1024**k)
        return f"{n / 1024**k:.1f} {units[k]}"

    for units in (("B", "KB", "MB", "GB", "TB", "PB"), ("B", "KB", "MB", "GB")):
        assert [r[0] for r in df.select(P.size_text(F.col("n"), units)).collect()] == [n if n is None else want(n, units) for n in sizes]
