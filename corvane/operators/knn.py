"""Exact nearest neighbours that leave out index cells which can hold none.

Index vectors are dealt to cells around centroids, fitted on a bounded sample. A cell knows its radius, the largest angle between its
centroid and a member, and the angle between a query and any member is at least that to the centroid less the radius. Each query first
meets its nearest cells, until they hold k vectors; its k-th distance there is a limit, and then it meets just those other cells whose least
angle is within that. So the result is exact, whatever the centroids are; they only decide how much is left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.runtime import materialise

#: Most vectors, and most bytes of them, that centroids are fitted on; most cells; rounds of fitting.
SAMPLE, SAMPLE_BYTES, CELLS, ROUNDS = 20_000, 64 << 20, 2_048, 6
#: Slack in angles and distances, beyond rounding; that of a distance by a matrix product.
SLACK, TINY = 1e-6, 1e-12
#: Queries and index vectors that meet at a time, and most rows that one group of queries finds.
TILE, FOUND = (512, 4_096), 1 << 20
#: The cell of vectors without a direction, which are at distance one from everything.
FLAT = -1


def search(q: pd.DataFrame, x: pd.DataFrame, k: int) -> pd.DataFrame:
    """(query_id, cand_id, distance): the k nearest rows of ``x`` for each row of ``q`` (both id, vec); of equal distances the smaller ids.

    A tile of queries meets a tile of ``x`` at a time and keeps what may be among its k nearest so far, so memory beyond both sides and the result is that of a tile. A
    matrix product finds these rows; their distances are then summed in the order of the dimensions, so that equal vectors are at equal distances.
    """
    if not len(q) or not len(x):
        return pd.DataFrame({"query_id": [], "cand_id": [], "distance": []})
    qid, ids = q["id"].to_numpy(), x["id"].to_numpy()
    a, b = np.stack(q["vec"].to_list()), np.stack(x["vec"].to_list())
    a_norm, b_norm = (np.sqrt(_dots(v, v, slice(None), slice(None))) for v in (a, b))
    out: list[tuple[np.ndarray, ...]] = []
    for top in range(0, len(qid), TILE[0]):
        some, norm = a[top : top + TILE[0]], a_norm[top : top + TILE[0]]
        row, col, dist = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        limit = np.full(len(some), np.inf)
        for lo in range(0, len(ids), TILE[1]):
            norms = norm[:, None] * b_norm[None, lo : lo + TILE[1]]
            d = some @ b[lo : lo + TILE[1]].T
            d = np.where(norms == 0, 1.0, 1 - np.divide(d, norms, out=d, where=norms != 0))
            if d.shape[1] > k:
                limit = np.minimum(limit, np.partition(d, k - 1, axis=1)[:, k - 1])
            r, c = np.nonzero(d <= limit[:, None] + TINY)
            n = norm[r] * b_norm[lo + c]
            exact = np.where(n == 0, 1.0, 1 - _dots(some, b, r, lo + c) / np.where(n == 0, 1, n))
            row, col, dist = np.concatenate([row, r]), np.concatenate([col, lo + c]), np.concatenate([dist, exact])
            order = np.lexsort((ids[col], dist, row))
            row, col, dist = row[order], col[order], dist[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            limit[row[place == k - 1]] = dist[place == k - 1]
            row, col, dist = row[place < k], col[place < k], dist[place < k]
        out.append((qid[top + row], ids[col], dist))
    return pd.DataFrame(dict(zip(("query_id", "cand_id", "distance"), map(np.concatenate, zip(*out)))))


def _dots(a: np.ndarray, b: np.ndarray, r, c) -> np.ndarray:
    """Products of rows ``r`` of one side and ``c`` of the other, summed in the order of the dimensions."""
    out = a[r, 0] * b[c, 0]
    for j in range(1, a.shape[1]):
        out += a[r, j] * b[c, j]
    return out


def unit(v: np.ndarray) -> np.ndarray:
    """Rows over their lengths; rows without one stay zero."""
    n = np.sqrt((v * v).sum(1, keepdims=True))
    return v / np.where(n == 0, 1, n)


def fit_centroids(index: DataFrame, cells: int, width: int) -> np.ndarray:
    """Directions around which a sample of the index gathers; the sample is the rows of the least hashes of their ids."""
    size = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * width)))
    rows = index.orderBy(F.xxhash64("id"), "id").limit(size).select("vec").toPandas()["vec"]
    v = unit(np.stack(rows.to_list()))
    v = v[(v * v).sum(1) > 0]
    c = v[np.linspace(0, len(v) - 1, min(cells, len(v))).astype(int)] if len(v) else np.zeros((1, width))
    for _ in range(ROUNDS):
        near = (v @ c.T).argmax(1) if len(v) else np.zeros(0, int)
        sums = np.zeros_like(c)
        np.add.at(sums, near, v)
        c = np.where((sums * sums).sum(1, keepdims=True) > 0, unit(sums), c)
    return c


def assign(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, vec, cell, angle) of (id, vec) rows."""

    def work(batches):
        for b in batches:
            if len(b):
                v = unit(np.stack(b["vec"].to_list()))
                cos = np.clip(v @ centroids.T, -1, 1)
                cell = cos.argmax(1)
                angle = np.arccos(cos[np.arange(len(b)), cell])
                flat = (v * v).sum(1) == 0
                yield b.assign(cell=np.where(flat, FLAT, cell), angle=np.where(flat, 0.0, angle))

    return rows.mapInPandas(work, "id long, vec array<double>, cell int, angle double")


def visits(queries: DataFrame, centroids: np.ndarray, cells: pd.DataFrame, k: int, limits: bool) -> DataFrame:
    """(id, vec, cell): the cells that each query meets.

    Without ``limits`` those of the nearest centroids that hold k vectors together; with them (column ``limit``, the k-th distance so far) all others that
    may hold a nearer vector. ``cells``: cell, n, radius.
    """
    own = cells[cells["cell"] != FLAT].reset_index(drop=True)
    ids = np.concatenate([own["cell"].to_numpy(), np.full(int((cells["cell"] == FLAT).any()), FLAT)]).astype(np.int32)
    sizes = cells.set_index("cell")["n"].loc[ids].to_numpy()
    middle, radius = centroids[own["cell"].to_numpy()], own["radius"].to_numpy()

    def work(batches):
        for b in batches:
            if not len(b):
                continue
            v = unit(np.stack(b["vec"].to_list()))
            flat = (v * v).sum(1) == 0
            away = np.arccos(np.clip(v @ middle.T, -1, 1))
            least = 1 - np.cos(np.maximum(away - radius[None, :] - SLACK, 0))
            least[flat] = 1.0
            if len(ids) > len(own):
                away, least = np.c_[away, np.full(len(b), np.pi)], np.c_[least, np.ones(len(b))]
            order = np.argsort(away, axis=1, kind="stable")
            before = np.cumsum(sizes[order], axis=1) - sizes[order]
            first = np.zeros(away.shape, bool)
            np.put_along_axis(first, order, before < k, 1)
            go = ~first & (least <= b["limit"].to_numpy()[:, None] + SLACK) if limits else first
            row, col = np.nonzero(go)
            yield pd.DataFrame({"id": b["id"].to_numpy()[row], "vec": b["vec"].to_numpy()[row], "cell": ids[col]})

    return queries.mapInPandas(work, "id long, vec array<double>, cell int")


def callers(room: int, k: int) -> int:
    """Queries in one group: their vectors find room, and so does what they find."""
    return max(1, min(room, FOUND // max(k, 1)))


def meet(calls: DataFrame, index: DataFrame, k: int, room: int) -> DataFrame:
    """The k nearest that each of ``calls`` (id, vec, cell) finds in its cell of ``index`` (id, vec, cell).

    A cell of more than ``room`` vectors is cut into parts that all its callers meet, and callers that may find more than FOUND rows into chunks that meet all parts, so no
    task has more of either.
    """
    spark = calls.sparkSession
    size = {r["cell"]: -(-r["n"] // room) for r in index.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    plan = [(r["cell"], size[r["cell"]], -(-r["n"] // callers(room, k))) for r in calls.groupBy("cell").agg(F.count("*").alias("n")).collect()]
    shares = F.broadcast(spark.createDataFrame(plan, "cell int, parts int, chunks int"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    left = calls.join(shares, "cell").select("id", "vec", "cell", each("parts").alias("part"), own("chunks").alias("chunk")).groupBy("cell", "part", "chunk")
    right = index.join(shares, "cell").select("id", "vec", "cell", own("parts").alias("part"), each("chunks").alias("chunk")).groupBy("cell", "part", "chunk")
    return left.cogroup(right).applyInPandas(lambda q, x: search(q, x, k), "query_id long, cand_id long, distance double")


def pruned(queries: DataFrame, index: DataFrame, k: int, count: int, width: int, room: int) -> DataFrame:
    """(query_id, cand_id, distance): the k nearest of ``index`` for each of ``queries`` are among these rows (both id, vec; ``count`` index rows)."""
    cells = max(1, min(CELLS, -(-4 * count // room)))
    middle = fit_centroids(index, cells, width)
    held = materialise(assign(index, middle), "cells")
    stats = held.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).toPandas()
    near = materialise(visits(queries, middle, stats, k, False), "first-calls")
    first = materialise(meet(near, held, k, room), "first")
    distances = first.groupBy("query_id").agg(F.array_sort(F.collect_list("distance")).alias("all"))
    kth = distances.select(F.col("query_id").alias("id"), F.when(F.size("all") >= k, F.get("all", F.lit(k - 1))).otherwise(2.0).alias("limit"))
    bounded = queries.join(kth, "id")
    rest = materialise(visits(bounded, middle, stats, k, True), "calls")
    return first.union(meet(rest, held, k, room))
