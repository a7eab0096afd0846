"""SimHash near-duplicates through pivot distance tables.

A fingerprint has 64 bits in four blocks of 16. For every block the Hamming distances to many
reference fingerprints are tabulated. Two fingerprints within two bits agree on two blocks at
least, so their distance vectors there are equal: an equi-join on the vectors of each pair of
blocks proposes pairs. A pair is discarded if any coordinate of its whole distance vectors
differs by more than the limit (triangle inequality); survivors are verified bit by bit.

Buckets of more than ``dense`` fingerprints, as a large group of near copies makes, do not go
through pairs. Two fingerprints within two bits share a point within one bit of both; so each
member emits itself and its 64 one-bit neighbours, and members that meet at a point are linked to
the least of them. That is exact, linear in the members, and no group exceeds 65 rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import hot
from corvane.llm.graph import components
from corvane.runtime import materialise, ship, table

BLOCKS, REFERENCES, LIMIT, DENSE = 4, 16, 2, 64
_BITS = np.array([[b >> k & 1 for k in range(8)] for b in range(256)], dtype=np.int64)
_CHUNK = 1 << 16


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint_of(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Signed 64-bit SimHash of the text's word shingles, repeats included; no words: zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < width:
        grams = iter([b" ".join(words)])
        n = 1
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(width))))
        n = len(words) - width + 1
    digest = xxhash.xxh64_intdigest
    counts = np.zeros((8, 8), dtype=np.int64)
    offsets = np.arange(8) * 256
    left = n
    while left > 0:
        m = min(left, _CHUNK)
        h = np.fromiter((digest(g, seed) for _, g in zip(range(m), grams)), dtype="<u8", count=m)
        at = h.view(np.uint8).reshape(m, 8) + offsets
        counts += np.bincount(at.ravel(), minlength=2048).reshape(8, 256) @ _BITS
        left -= m
    on = (2 * counts > n).astype(np.uint8)
    return int(np.packbits(on, axis=1, bitorder="little").reshape(8).view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, fp) for each row of ``docs``; only the two columns are read."""
    ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            fps = [fingerprint_of(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, "doc_id long, fp long")


def _references() -> list[int]:
    return [xxhash.xxh64_intdigest(f"reference {k}", 7) for k in range(REFERENCES)]


def links(fps: DataFrame, dense: int = DENSE) -> DataFrame:
    """Pairs (u, v) of distinct fingerprints within two bits: all of them outside dense buckets,
    and within those enough to connect whatever is connected."""
    refs = _references()
    masks = [0xFFFF << (16 * k) for k in range(BLOCKS)]
    near = lambda m: F.array(*(F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(r))).bitwiseAND(F.lit(_signed(m)))).cast("byte") for r in refs))
    tabled = fps.select("fp", *(near(m).alias(f"t{k}") for k, m in enumerate(masks)), near((1 << 64) - 1).alias("t"))
    keyed = tabled.select(
        "fp", "t",
        F.explode(F.array(*(F.xxhash64(F.lit(10 * a + b), f"t{a}", f"t{b}") for a, b in combinations(range(BLOCKS), 2)))).alias("key"),
    )
    keyed = materialise(keyed, "pivots")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    total = keyed.count()
    open_keys, full_keys = sizes.where(F.col("n") <= dense).select("key"), sizes.where(F.col("n") > dense)
    heavy = F.broadcast(full_keys.where(F.col("n") * hot.HOT >= total).select("key"))  # their rows stay where they are
    left = keyed.join(heavy, "key", "left_anti").join(open_keys, "key", "left_semi")
    a, b = left.select("key", F.col("fp").alias("u"), F.col("t").alias("tu")), left.select("key", F.col("fp").alias("v"), F.col("t").alias("tv"))
    far = F.array_max(F.zip_with("tu", "tv", lambda x, y: F.abs(x - y)))
    pairs = a.join(b, "key").where("v < u").where(far <= LIMIT).where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= LIMIT).select("u", "v")
    crowded = hot.join(keyed, full_keys, "key", "n", total).select("fp").distinct()
    around = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(_signed(1 << k))) for k in range(64)))
    points = crowded.select("fp", F.explode(around).alias("point"))
    least = points.groupBy("point").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1").select("point", "v")
    stars = points.join(least, "point").where("fp <> v").select(F.col("fp").alias("u"), "v")
    return pairs.union(stars)


def near_duplicates(docs: DataFrame, dense: int = DENSE) -> DataFrame:
    """(doc_id, fp, component_id) for each row.

    component_id is the smallest doc_id among the rows reachable over links of two bits or
    fewer. Null and empty texts have fingerprint zero and are linked like others; a null id gets
    its group's component but never names one; repeated rows give repeated rows.
    """
    rows = materialise(fingerprints(docs), "fingerprints")
    fps = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("m")), "distinct-fingerprints")
    comp = components(links(fps.select("fp"), dense))
    named = fps.join(comp.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "m", "first_id", F.coalesce("component", "fp").alias("component"))
    named = materialise(named, "named")
    root = named.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count("*").alias("k"))
    told = materialise(hot.join(named, root, "component", "k", named.count()).select("fp", "m", "component_id"), "told")
    return hot.join(rows, told, "fp", "m", rows.count()).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of ``groups`` (doc_id, text_hash, kept): the rows that are ``kept``.

    A row is known by its id, which may be null, and xxhash64 of its text; of rows equal in both one stays, whichever. All columns
    come along, whatever their names; an empty table stays empty.
    """
    found = materialise(groups.groupBy("doc_id", "text_hash").agg(F.max("kept").alias("kept"), F.count("*").alias("n")), "groups")
    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.struct("*").alias("all"))
    same = lambda some: packed["doc_id"].eqNullSafe(some["doc_id"]) & (packed["text_hash"] == some["text_hash"])
    gone, again = found.where("not kept"), found.where("kept and n > 1")
    if again.limit(1).count():
        several = packed.join(again, same(again), "left_semi").groupBy("doc_id", "text_hash").agg(F.first("all").alias("all")).select("all.*")
        rest = found.where("not kept or n > 1")
        return packed.join(rest, same(rest), "left_anti").select("all.*").union(several)
    return packed.join(gone, same(gone), "left_anti").select("all.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of ``documents``, a row each; nulls, empty texts and repeated rows as in :func:`near_duplicates`."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
