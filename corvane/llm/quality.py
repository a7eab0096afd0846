"""Quality classifier: random Fourier features, ridge regression from partition sums, isotonic calibration.

Document statistics are computed once from whole texts. Random Fourier features of the
standardised statistics approximate a Gaussian kernel. Each partition sums its normal equations,
by fold; the sums are added in two levels and a few hundred kilobytes reach the driver, where the ridge
systems are solved. Models that leave one fold out score that fold, and these scores, counted
in narrow bins, fit the isotonic calibration.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.text import crc_fold
from corvane.runtime import materialise, ship, table

N_STATS, N_FOURIER, RIDGE, FOLDS, BINS = 26, 192, 3.0, 5, 2000
THRESHOLD, SEED = 0.3, 11
_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[[ord(c) for c in ".,;:'\"-()?"]] = 5
_CLASS[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 6
_CLASS[128:] = 7


def statistics(text: str | None) -> np.ndarray:
    """The statistics of one whole text; null and empty texts give zeros."""
    out = np.zeros(N_STATS, dtype=np.float32)
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return out
    hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n = len(data)
    share = np.bincount(_CLASS, weights=hist, minlength=8) / n
    p = hist[hist > 0] / n
    words = data.split()
    nw = max(1, len(words))
    lens = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    counts = Counter(words)
    often = np.fromiter(counts.values(), np.int64, len(counts)) if counts else np.zeros(1, np.int64)
    q = often / nw
    pairs = len(set(zip(words, words[1:]))) / max(1, nw - 1)
    lines = data.split(b"\n")
    nl = len(lines)
    out[:8] = share
    out[8:] = (
        np.log1p(n), np.log1p(len(words)), -(p * np.log2(p)).sum(), lens.mean(), lens.std(), np.log1p(lens.max()), len(counts) / nw,
        q.max(), (q * q).sum(), pairs, np.log1p(nl), len(set(lines)) / nl, hist[124] / nw, share[6] * n / nw, share[5] * n / nw,
        (lens <= 3).mean(), share[2] / (share[1] + share[2] + 1e-3), max(counts.values(), default=0) / max(1, len(counts)),
    )
    return out


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, fold, stats, text_hash) for each row; only doc_id and text are read."""
    ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            rows = b.column(2).to_pylist()
            flat = np.concatenate([statistics(t) for t in rows]) if rows else np.zeros(0, np.float32)
            stats = pa.ListArray.from_arrays(pa.array(np.arange(0, N_STATS * (len(rows) + 1), N_STATS), pa.int32()), pa.array(flat, pa.float32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), stats, b.column(3)], names=["doc_id", "fold", "stats", "text_hash"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), crc_fold(F.col("doc_id"), FOLDS).alias("fold"), F.col("text"), F.xxhash64("text").alias("text_hash"))
    return picked.mapInArrow(run, "doc_id long, fold int, stats array<float>, text_hash long")


class Fourier:
    """Standardisation and the random projection; small, sent with the tasks."""

    def __init__(self, mean: np.ndarray, std: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, 1.0 / np.where(std > 1e-9, std, 1.0)
        self.w = rng.standard_normal((N_STATS, N_FOURIER)) / np.sqrt(N_STATS)
        self.b = rng.uniform(0, 2 * np.pi, N_FOURIER)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) * self.scale, -8, 8)
        return np.hstack([np.sqrt(2.0 / N_FOURIER) * np.cos(z @ self.w + self.b), np.ones((len(z), 1))])


def _matrix(column) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, N_STATS)


def _normal_equations(train: DataFrame, four: Fourier) -> dict[int, np.ndarray]:
    """By fold the matrix [A | b] (and nothing else) summed over partitions."""
    d = N_FOURIER + 1

    def part(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            fold, y = b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.float64)
            z = four(_matrix(b.column(2)))
            for f in np.unique(fold):
                m = fold == f
                sums[int(f)] = sums.get(int(f), 0) + z[m].T @ np.hstack([z[m], y[m, None]])
        keys = sorted(sums)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([sums[k].tobytes() for k in keys], pa.binary())], names=["fold", "m"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x) for x in pdf["m"])
        return pd.DataFrame({"fold": [pdf["fold"].iloc[0]], "m": [total.tobytes()]})

    parts = train.select("fold", "y", "stats").mapInArrow(part, "fold int, m binary")
    few = parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64))).groupBy("fold", "salt").applyInPandas(add, "fold int, m binary")
    rows = few.groupBy("fold").applyInPandas(add, "fold int, m binary").collect()  # one matrix for each fold
    return {r["fold"]: np.frombuffer(r["m"]).reshape(d, d + 1) for r in rows}


def _solve(m: np.ndarray) -> np.ndarray:
    a = m[:, :-1] + RIDGE * np.eye(len(m))
    return np.linalg.solve(a, m[:, -1])


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins ordered by x with mean y and weight n: knots to interpolate between."""
    blocks: list[list[float]] = []
    for xi, yi, ni in zip(x, y, n):
        blocks.append([yi * ni, ni, xi * ni])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


def _raw(rows: DataFrame, four: Fourier, models: dict[int, np.ndarray], knots: tuple | None) -> DataFrame:
    """(doc_id, fold, raw or score, text_hash) with the model of the row's fold."""

    def run(batches):
        for b in batches:
            z, fold = four(_matrix(b.column(2))), b.column(1).to_numpy()
            raw = np.zeros(len(z))
            for f, w in models.items():
                raw[fold == f] = z[fold == f] @ w
            if knots is not None:
                raw = np.clip(np.interp(raw, *knots), 0, 1) if len(knots[0]) else np.clip(raw, 0, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(raw), b.column(3)], names=["doc_id", "fold", "raw", "text_hash"])

    return rows.select("doc_id", "fold", "stats", "text_hash").mapInArrow(run, "doc_id long, fold int, raw double, text_hash long")


def score(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """(doc_id, fold, score, text_hash) for each row of ``docs``; text_hash is xxhash64 of the text.

    Learns from labelled rows outside fold 0 (crc32 of the id as text modulo 5). The score is the calibrated
    probability of label 1. Null and empty texts are scored from zero statistics; rows with a
    null label or id teach nothing; an id labelled twice counts with its larger label; without any usable
    label every score is 1.
    """
    rows = materialise(features(docs), "statistics")
    known = labels.where(f"{label} is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("double").alias("y"))
    train = materialise(rows.where("fold <> 0").join(known, "doc_id"), "labelled")
    cols = [F.col("stats")[k] for k in range(N_STATS)]
    got = train.agg(F.count("*"), *(F.avg(c) for c in cols), *(F.stddev_pop(c) for c in cols)).first()
    if not got[0]:
        return rows.select("doc_id", "fold", F.lit(1.0).alias("score"), "text_hash")
    four = Fourier(np.array(got[1 : 1 + N_STATS]), np.array(got[1 + N_STATS :]))
    sums = _normal_equations(train, four)
    whole = sum(sums.values())
    without = {f: _solve(whole - m) if len(sums) > 1 else _solve(whole) for f, m in sums.items()}
    raw = _raw(train, four, without, None).join(known, "doc_id")
    cell = F.least(F.greatest(F.floor((F.col("raw") + 0.5) * (BINS / 2)), F.lit(0)), F.lit(BINS - 1))
    bins = sorted(map(tuple, raw.groupBy(cell.alias("bin")).agg(F.avg("raw"), F.avg("y"), F.count("*")).collect()))  # BINS rows at most
    x, y, n = (np.array([b[k] for b in bins], dtype=np.float64) for k in (1, 2, 3))
    knots = isotonic(x, y, n)
    return _raw(rows, four, dict.fromkeys(range(FOLDS), _solve(whole)), knots).withColumnRenamed("raw", "score")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without rows that score below ``threshold``, with all columns, whatever their names.

    A row is known by its id, which may be null, and its text, so texts under one id are judged apart; repeated rows share their fate.
    """
    bad = score(docs, labels).where(F.col("score") < threshold).select("doc_id", "text_hash").distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.struct("*").alias("all"))
    return rows.join(bad, rows["doc_id"].eqNullSafe(bad["doc_id"]) & (rows["text_hash"] == bad["text_hash"]), "left_anti").select("all.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of ``documents``, with nulls, empty texts and labels as in :func:`score`; predicted is 1 from THRESHOLD on."""
    found = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", (F.col("fold") == 0).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
