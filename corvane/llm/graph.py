"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import hot
from corvane.runtime import discard, materialise


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
    return hot.join(both.where("v > u"), least, "u", "n", total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = hot.join(down, least, "u", "n", total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows (u, component) for every node that has an edge to another one.

    ``edges`` has comparable columns u and v; loops and repeated edges are harmless, a null end is none; no edges give no rows. Each round
    is two group-and-join steps over at most as many edges as there were; minima are combined before the shuffle, and
    hubs are joined where their edges are. The edges of each step go to the shared scratch space, which cuts the lineage. It stops when
    a round leaves the edges as they were, and fails loudly rather than return a partial result.
    """
    edges = materialise(edges.where("u <> v").select("u", "v").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return edges.groupBy("u").agg(F.min("v").alias("component")).union(
                edges.groupBy(F.col("v").alias("u")).agg(F.min("v").alias("component"))
            ).groupBy("u").agg(F.min("component").alias("component"))
        before = state
        large = materialise(_large_star(edges, state[0]).distinct(), "edges")
        small = materialise(_small_star(large, state[0]).distinct(), "edges")
        discard(edges, large)
        edges = small
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
