"""Nearest neighbours by cells against all distances."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest

from corvane.operators import knn
from corvane.operators import vector as V


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "id long, vec array<double>")


def brute(q, x, k):
    n = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
    d = np.where(n == 0, 1.0, 1 - q @ x.T / np.where(n == 0, 1, n))
    return [[(r, j, d[i, j]) for r, j in enumerate(sorted(range(len(x)), key=lambda j: (d[i, j], j))[:k], 1)] for i in range(len(q))]


def clustered(seed, n, groups, width, spread):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((groups, width))[rng.integers(groups, size=n)] + spread * rng.standard_normal((n, width))


@pytest.mark.parametrize("spread", [0.05, 0.5, 5.0])
def test_cells_give_all_neighbours(spark, monkeypatch, spread):
    x = clustered(3, 900, 12, 8, spread)
    x[5] = x[77] = 0.0  # no direction
    x[100:104] = x[99]  # ties
    q = np.concatenate([clustered(3, 40, 12, 8, spread), np.zeros((1, 8)), x[99:100]])
    monkeypatch.setattr(V, "BLOCK_BYTES", 8 * 8 * 100)
    rows = V.nearest(frame(spark, range(len(q)), q), frame(spark, range(len(x)), x), 7).toPandas().sort_values(["query_id", "rank"])
    want = brute(q, x, 7)
    for k, (_, g) in enumerate(rows.groupby("query_id")):
        assert np.allclose(g["distance"], [d for _, _, d in want[k]], atol=1e-8)
        if k != 41:  # which has ties that rounding may order either way
            assert list(zip(g["rank"], g["cand_id"])) == [(r, c) for r, c, _ in want[k]]


def test_cells_that_can_hold_none_are_left_out(spark):
    x, q = clustered(4, 3000, 30, 16, 0.1), clustered(4, 100, 30, 16, 0.1)
    index, queries = frame(spark, range(3000), x), frame(spark, range(100), q)
    middle = knn.fit_centroids(index, 30, 16)
    held = knn.assign(index, middle).toPandas()
    cells = held.groupby("cell").agg(n=("id", "count"), radius=("angle", "max")).reset_index()
    kth = [row[-1][2] for row in brute(q, x, 5)]
    bounded = spark.createDataFrame(pd.DataFrame({"id": range(100), "vec": q.tolist(), "limit": kth}), "id long, vec array<double>, limit double")
    met = knn.visits(queries, middle, cells, 5, False).count() + knn.visits(bounded, middle, cells, 5, True).count()
    assert met < 0.2 * 100 * len(cells)


def test_fewer_vectors_than_asked_for(spark, monkeypatch):
    x = clustered(5, 6, 2, 4, 0.1)
    monkeypatch.setattr(V, "BLOCK_BYTES", 8 * 4 * 2)
    rows = V.nearest(frame(spark, [0], x[:1]), frame(spark, range(6), x), 50)
    assert sorted(r["cand_id"] for r in rows.collect()) == list(range(6))
    assert V.nearest(frame(spark, [0], x[:1]), frame(spark, range(6), x).limit(0), 5).count() == 0


def test_many_queries_need_the_memory_of_a_tile():
    rng = np.random.default_rng(6)
    x, q = (pd.DataFrame({"id": range(n), "vec": list(rng.standard_normal((n, 8)))}) for n in (5_000, 6_000))
    x.loc[4_000:, "vec"] = pd.Series(list(np.stack(x["vec"].to_list())[:1_000]), index=range(4_000, 5_000))  # twins, at equal distances
    tracemalloc.start()
    got = knn.search(q, x, 10)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 160 << 20  # all distances at once are 240 MB, and were held several times over
    d = 1 - np.stack(q["vec"].to_list()[:50]) @ np.stack(x["vec"].to_list()).T / np.outer(*(np.linalg.norm(np.stack(v["vec"].to_list()[:n]), axis=1) for v, n in ((q, 50), (x, 5_000))))
    d = d.round(12)
    want = np.lexsort((np.broadcast_to(np.arange(5_000), d.shape), d))[:, :10]
    assert got["cand_id"].to_numpy()[:500].tolist() == want.ravel().tolist()
