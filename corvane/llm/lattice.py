"""Embedding near-duplicates by E8 lattice hashing.

In each of several tables a vector's random projection onto sixteen dimensions is decoded to a pair of
E8 lattice points, the cell. A vector is filed under its own cell and also calls at the neighbouring cells
nearest to it. Vectors that meet in a cell are verified by their cosine in double precision.

Equal vectors are one class first. Cells are worked in blocks of bounded size, block against
block, and a block gives back counts and a spanning set of links, never its pairs, so a cell
that holds a large group neither lands in one task nor emits a row for each pair. A pair that meets in several cells counts in the first
of them only, which both sides can tell from the cells they carry.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import hot
from corvane.llm.graph import components
from corvane.runtime import materialise, ship, table

TABLES, PROBES, SCALE, SEED, BLOCK = 12, 6, 5.0, 5, 256
LEAST_COSINE = 0.95


def _minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    whole = []
    for i in range(8):
        for j in range(i):
            for a, b in product((1, -1), repeat=2):
                v = np.zeros(8)
                v[i], v[j] = a, b
                whole.append(v)
    half = [np.array(s) / 2 for s in product((1.0, -1.0), repeat=8) if np.prod(s) > 0]
    return np.array(whole + half)


_NEAR = _minimal_vectors()


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest points of D8 (integers of even sum)."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(1) % 2 != 0)
    if len(odd):
        off = x[odd] - r[odd]
        k = np.abs(off).argmax(1)
        r[odd, k] += np.where(off[np.arange(len(odd)), k] >= 0, 1, -1)
    return r


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, the union of D8 and D8 shifted by one half."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    nearer = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    return np.where(nearer[:, None], a, b)


def _mix(points: np.ndarray, salt: int) -> np.ndarray:
    """64-bit hashes of doubled lattice points."""
    with np.errstate(over="ignore"):
        h = np.full(len(points), np.uint64(salt * 2 + 1) * np.uint64(0x9E3779B97F4A7C15))
        for k in range(points.shape[1]):
            h = (h ^ points[:, k].astype(np.int64).view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
    return h.view(np.int64)


def cells(unit: np.ndarray) -> np.ndarray:
    """For each unit vector its cells, [n, TABLES, PROBES]; the first of each table is its own."""
    n, dim = unit.shape
    rng = np.random.default_rng([SEED, dim])
    out = np.zeros((n, TABLES, PROBES), np.int64)
    for t in range(TABLES):
        q = rng.standard_normal((dim, 16))
        q = np.linalg.qr(q)[0] if dim >= 16 else q / 4
        proj = unit @ q * (SCALE * np.sqrt(dim / 64)) + rng.uniform(0, 1, 16)
        choices, costs = [], []
        for half in (proj[:, :8], proj[:, 8:16]):
            home = decode(half)
            gain = (half - home) @ _NEAR.T
            best = np.argpartition(-gain, PROBES - 1, axis=1)[:, : PROBES - 1]
            best = np.take_along_axis(best, np.argsort(-np.take_along_axis(gain, best, 1), axis=1), 1)
            choices.append(np.concatenate([home[:, None], home[:, None] + _NEAR[best]], 1))
            costs.append(np.concatenate([np.zeros((n, 1)), 2 - 2 * np.take_along_axis(gain, best, 1)], 1))
        both = (costs[0][:, :, None] + costs[1][:, None, :]).reshape(n, -1)
        order = np.argsort(both, axis=1, kind="stable")[:, :PROBES]
        for p in range(PROBES):
            i, j = order[:, p] // PROBES, order[:, p] % PROBES
            rows = np.arange(n)
            out[:, t, p] = _mix(2 * np.hstack([choices[0][rows, i], choices[1][rows, j]]), t)
    return out


def _digests(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding, same) for each row; same is a digest of the vector, null if it can't link."""
    import hashlib

    def run(batches):
        for b in batches:
            out = []
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                a = None if i is None or not v or None in v else np.asarray(v, np.float64)
                ok = a is not None and np.isfinite(a).all() and a.any()
                out.append(hashlib.blake2b((a + 0.0).tobytes(), digest_size=16).digest() if ok else None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=["vec_id", "embedding", "same"])

    return vectors.mapInArrow(run, "vec_id long, embedding array<double>, same binary")


def _filed(reps: DataFrame) -> DataFrame:
    """(rep, copies, unit, cells): the unit vector and its cells as raw bytes, and keys of the cells."""

    def run(batches):
        for b in batches:
            rows = [np.asarray(v, np.float64) for v in b.column(2).to_pylist()]
            units = [v / np.abs(v).max() for v in rows]
            units = [v / np.sqrt(v @ v) for v in units]
            keys: list = [None] * len(units)
            for dim in {len(v) for v in units}:
                at = [k for k, v in enumerate(units) if len(v) == dim]
                for lo in range(0, len(at), 512):
                    some = at[lo : lo + 512]
                    for k, c in zip(some, cells(np.array([units[k] for k in some]))):
                        keys[k] = c
            arrays = [b.column(0), b.column(1), pa.array([v.tobytes() for v in units], pa.binary()), pa.array([c.tobytes() for c in keys], pa.binary()), pa.array([c.ravel().tolist() for c in keys], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["rep", "copies", "unit", "cells", "keys"])

    return reps.mapInArrow(run, "rep long, copies long, unit binary, cells binary, keys array<long>")


def first_meeting(ids: np.ndarray, filed: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For pairs of rows (i, j) the key of the first cell in which they meet; filed is [n, TABLES, PROBES]."""
    lo, hi = np.where(ids[i] < ids[j], i, j), np.where(ids[i] < ids[j], j, i)
    out, open_ = np.zeros(len(i), np.int64), np.arange(len(i))
    for t in range(filed.shape[1]):
        for x, y in ((lo, hi), (hi, lo)):
            home = filed[x[open_], t, 0]
            met = (filed[y[open_], t] == home[:, None]).any(1)
            out[open_[met]] = home[met]
            open_ = open_[~met]
    return out


def _linked(ids, copies, home, side, within: bool, units, filed, key: int, least: float):
    """(rep, links, root) of the rows of one pair of blocks of a cell that link with another."""
    sizes = np.array([len(u) for u in units])
    links, root = np.zeros(len(ids), np.int64), ids.copy()
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        u = np.frombuffer(b"".join(units[k] for k in at)).reshape(len(at), -1)
        i, j = np.nonzero(np.triu(u @ u.T >= least, 1))
        i, j = at[i], at[j]
        ok = home[i] | home[j]
        if not within:
            ok &= side[i] != side[j]
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        while True:
            least_root = np.minimum(root[i], root[j])
            before = root.copy()
            np.minimum.at(root, i, least_root)
            np.minimum.at(root, j, least_root)
            if (before == root).all():
                break
        some = np.unique(np.concatenate([i, j]))
        cells_of = np.frombuffer(b"".join(filed[k] for k in some), np.int64).reshape(-1, TABLES, PROBES)
        first = first_meeting(ids[some], cells_of, np.searchsorted(some, i), np.searchsorted(some, j)) == key
        np.add.at(links, i[first], copies[j[first]])
        np.add.at(links, j[first], copies[i[first]])
    told = (links > 0) | (root != ids)
    return ids[told], links[told], root[told]


def _work(least: float):
    """Links of the groups of rows with equal (key, a, b), which follow one another; no group has over 2 x BLOCK rows or so."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        now = None

        def told():
            t = pa.Table.from_batches(held)
            held.clear()
            if t.num_rows < 2:
                return
            ids, copies, home, side = (t.column(k).combine_chunks().to_numpy(zero_copy_only=False) for k in (3, 4, 5, 6))
            out = _linked(ids, copies, home.astype(bool), side, now[1] == now[2], t.column(7).to_pylist(), t.column(8).to_pylist(), now[0], least)
            if len(out[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["rep", "links", "root"])

        for batch in batches:
            key, a, b = (batch.column(k).to_numpy() for k in range(3))
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                mark = (int(key[lo]), int(a[lo]), int(b[lo])) if hi > lo else now
                if mark != now and held:
                    yield from told()
                now = mark
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from told()

    return run


def near_duplicates(vectors: DataFrame, least: float = LEAST_COSINE, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, embedding).

    Links only pairs whose cosine reaches ``least``, and finds them with the recall that the
    tables give (over 0.99 at cosine 0.95). Null, empty, zero and non-finite vectors, and rows with a null id,
    link with nothing; vectors of other lengths never link. Rows repeated under one id link with each other, and different vectors under
    one id are told apart. An empty table gives no rows; other columns may have any names.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    ids = materialise(_digests(rows), "vector-digests")
    classes = ids.where("same is not null").groupBy("same").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    classes = materialise(classes.withColumn("rep", F.monotonically_increasing_id()), "vector-classes")  # numbers that the files keep
    filed = materialise(_filed(classes.select("rep", "copies", "embedding")), "cells")
    each = filed.select("rep", F.posexplode("keys").alias("at", "key")).select("rep", "key", (F.col("at") % PROBES == 0).alias("home"))
    each = materialise(each.groupBy("key", "rep").agg(F.max("home").alias("home")), "calls")
    full = each.groupBy("key").agg(F.count("*").alias("n"), F.max("home").alias("any_home")).where("n > 1 and any_home").select("key", "n")
    met = each.join(full, "key").join(filed.select("rep", "copies", "unit", "cells"), "rep")
    chunks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("rep"), chunks).cast("int")
    dealt = met.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "rep", "copies", "home", "own", "unit", "cells")
    dealt = dealt.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")
    told = materialise(dealt.mapInArrow(_work(least), "rep long, links long, root long"), "links")
    comp = components(told.select(F.col("rep").alias("u"), F.col("root").alias("v"))).withColumnRenamed("u", "rep")
    links = told.groupBy("rep").agg(F.sum("links").alias("links"))
    named = classes.select("same", "rep", "least_id", "copies").join(links, "rep", "left").join(comp, "rep", "left")
    named = materialise(named.select("same", "least_id", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component")), "named")
    roots = named.groupBy("component").agg(F.min("least_id").alias("component_id"), F.count("*").alias("m"))
    by_class = materialise(hot.join(named, roots, "component", "m", named.count()).select("same", "copies", "n_links", "component_id"), "by-class")
    some = ids.where("same is not null").select("vec_id", "same")
    found = hot.join(some, by_class, "same", "copies", some.count()).select("vec_id", "n_links", "component_id")
    alone = ids.where("same is null").select("vec_id", F.lit(0).alias("n_links"), F.col("vec_id").alias("component_id"))
    out = found.union(alone).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of ``embeddings``; vectors that can't link are components of their own."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
n AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS u FROM v WHERE list_inner_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND list_inner_product(a.u, b.u) >= 0.95),
reach AS (
  WITH RECURSIVE r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
  SELECT a, min(b) AS m FROM r GROUP BY a),
d AS (SELECT a, count(*) AS k FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(k, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, least(vec_id, coalesce(m, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN d ON d.a = vec_id LEFT JOIN reach ON reach.a = vec_id
"""
