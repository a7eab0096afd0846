"""Nearest neighbours over vectors, health of a query, late fusion, and re-ranking by further signals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators import knn
from corvane.runtime import ship

BLOCK_BYTES = 32 << 20


@dataclass(frozen=True)
class Matching:
    """Settings of two-space matching."""

    k: int = 100
    weight_a: float = 0.5
    weight_b: float = 0.5
    missing: float = 0.5
    max_distance: float = 0.8
    max_results: int = 10


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine in double precision; 1 where a norm is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 1.0).otherwise(1 - dot(a, b) / F.nullif(norms, F.lit(0.0)))


def normalise(v: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    n = F.sqrt(dot(v, v))
    return F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n))


def average_with_flip(v: Column, flipped: Column) -> Column:
    return normalise(F.zip_with(v, flipped, lambda x, y: (x + y) / 2))


def nearest(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """(query_id, cand_id, distance, rank): the exact k nearest of ``index`` (id, vec) for each of ``queries`` (id, vec).

    An index beyond one block is dealt to cells, of which a query meets those alone that may hold a neighbour (``knn``). A smaller one is dealt to the cores
    by a hash of the ids, and each block of queries (no more than find ``knn.FOUND`` rows) meets each of its parts. A window with a group limit merges what the tasks find.
    """
    ship(queries.sparkSession)
    q, x = (df.where("vec is not null").select("id", F.col("vec").cast("array<double>").alias("vec")) for df in (queries, index))
    sizes = [df.agg(F.count("*"), F.max(F.size("vec"))).first() for df in (q, x)]
    room = max(1, BLOCK_BYTES // (8 * (sizes[1][1] or 1)))
    if sizes[1][0] > room:
        found = knn.pruned(q, x, k, sizes[1][0], sizes[1][1], room)
    else:
        q_blocks = -(-sizes[0][0] // knn.callers(room, k)) or 1
        x_blocks = max(1, -(-queries.sparkSession.sparkContext.defaultParallelism // q_blocks))

        def dealt(rows: DataFrame, mine: int, others: int, names: tuple[str, str]) -> DataFrame:
            rows = rows.withColumn(names[0], F.pmod(F.xxhash64("id"), F.lit(mine)).cast("int"))
            return rows.withColumn(names[1], F.explode(F.sequence(F.lit(0), F.lit(others - 1)))).groupBy("qb", "xb")

        both = dealt(q, q_blocks, x_blocks, ("qb", "xb")).cogroup(dealt(x, x_blocks, q_blocks, ("xb", "qb")))
        found = both.applyInPandas(lambda a, b: knn.search(a, b, k), "query_id long, cand_id long, distance double")
    w = Window.partitionBy("query_id").orderBy("distance", "cand_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def query_stats(neighbours: DataFrame, first: int = 20) -> DataFrame:
    """By query the least distance, and population variance and range over the first ranks."""
    return neighbours.where(F.col("rank") <= first).groupBy("query_id").agg(
        F.min("distance").alias("min_d"), F.var_pop("distance").alias("var_d"), (F.max("distance") - F.min("distance")).alias("range_d")
    )


def health(min_d: Column, var_d: Column, range_d: Column) -> Column:
    """Whether a query's neighbours look like a working model's."""
    return (
        F.when(min_d.isNull(), "no_results").when(min_d >= 0.20, "healthy")
        .when((min_d < 0.10) & ((var_d < 0.002) | (range_d < 0.05)), "degenerate")
        .when((range_d < 0.03) & (var_d < 0.001), "degenerate").otherwise("healthy")
    )


def strategy(health_a: Column, health_b: Column) -> Column:
    a, b = health_a == "healthy", health_b == "healthy"
    return F.when(a & b, "weighted").when(a, "a_only").when(b, "b_only").otherwise("a_fallback")


def weights(plan: Column, m: Matching) -> tuple[Column, Column]:
    wa = F.when(plan == "weighted", m.weight_a).when(plan == "b_only", 0.0).otherwise(1.0)
    wb = F.when(plan == "weighted", m.weight_b).when(plan == "b_only", 1.0).otherwise(0.0)
    return wa, wb


def clamp_confidence(d: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - d))


def fuse(near_a: DataFrame, near_b: DataFrame, plans: DataFrame, mapping: DataFrame, m: Matching = Matching()) -> DataFrame:
    """Full outer join of the two candidate lists with the plan of each query.

    Side B counts only where its weight is positive; under "weighted" a missing side is imputed,
    otherwise a one-sided candidate keeps its raw distance. Candidates without a mapping (cand_id, entity) fall away.
    """
    wa, wb = weights(F.col("plan"), m)
    known = plans.select("query_id", "plan", wa.alias("wa"), wb.alias("wb"))
    a = near_a.select("query_id", "cand_id", F.col("distance").alias("da"))
    b = near_b.join(known.where("wb > 0").select("query_id"), "query_id", "left_semi").select("query_id", "cand_id", F.col("distance").alias("db"))
    both = a.join(b, ["query_id", "cand_id"], "full_outer").join(known, "query_id").join(mapping, "cand_id")
    weighted = F.col("plan") == "weighted"
    d = (
        F.when(F.col("da").isNotNull() & F.col("db").isNotNull(), F.col("da") * F.col("wa") + F.col("db") * F.col("wb"))
        .when(weighted, F.coalesce("da", F.lit(m.missing)) * F.col("wa") + F.coalesce("db", F.lit(m.missing)) * F.col("wb"))
        .otherwise(F.coalesce("da", "db"))
    )
    return both.withColumn("distance", d)


def top_matches(fused: DataFrame, m: Matching = Matching()) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("distance", "cand_id")
    kept = fused.where(F.col("distance") <= m.max_distance).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= m.max_results)
    return kept.withColumn("confidence", clamp_confidence(F.col("distance")))


def match_by_entity(near_a: DataFrame, near_b: DataFrame, mapping: DataFrame, top: int) -> DataFrame:
    """Earlier form of matching: an entity's largest distance on each side, both needed, averaged."""
    side = lambda n, c: n.join(mapping, "cand_id").groupBy("query_id", "entity").agg(F.max("distance").alias(c))
    both = side(near_a, "da").join(side(near_b, "db"), ["query_id", "entity"]).withColumn("distance", (F.col("da") + F.col("db")) / 2)
    w = Window.partitionBy("query_id").orderBy("distance", "entity")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def mark_similarity(neighbours: DataFrame, mapping: DataFrame) -> DataFrame:
    """Best similarity, max(0, 1 - distance), of each entity for a query."""
    return neighbours.join(mapping, "cand_id").groupBy("query_id", "entity").agg(F.max(F.greatest(F.lit(0.0), 1 - F.col("distance"))).alias("similarity"))


def body_multiplier(diff: Column) -> Column:
    d = F.abs(diff)
    return F.when(d.isNull(), 1.0).when(d > 0.35, 0.3).when(d > 0.2, 0.6).when(d > 0.12, 0.85).otherwise(1.0)


def mark_multiplier(searched: Column, has_marks: Column, similarity: Column, known: Column) -> Column:
    """searched: whether marks were looked for; has_marks: whether the query shows any; known: whether the entity has marks on file."""
    return (
        F.when(~searched, 1.0).when(~has_marks, F.when(known, 0.95).otherwise(1.0))
        .when(similarity > 0.7, 1.3 + (similarity - 0.7) * (0.2 / 0.3)).when(similarity > 0.5, 1.1).when(~known, 0.7).otherwise(1.0)
    )


def rerank(rows: DataFrame, group: str, body: Column, mark: Column, top: int) -> DataFrame:
    """Order by 1 / (1 + distance) times both multipliers, ties by the rank before."""
    scored = rows.withColumn("score", 1 / (1 + F.col("distance")) * body * mark)
    w = Window.partitionBy(group).orderBy(F.desc("score"), "rank")
    return scored.withColumn("new_rank", F.row_number().over(w)).where(F.col("new_rank") <= top)


def fuse_spaces(found: dict[str, DataFrame | None], weights: dict[str, float], missing: float) -> DataFrame:
    """(query_id, cand_id, spaces, distance) over any number of spaces: the weighted mean of a candidate's distances, ``missing`` where a space that was searched
    didn't find it. A space without an index (None) takes no part, and its weight goes to the others in proportion; ``spaces`` counts those that found the candidate."""
    here = {n: df for n, df in found.items() if df is not None}
    if not here:
        raise ValueError("no space has an index")
    whole = sum(weights[n] for n in here)
    rows = None
    for n, df in here.items():
        one = df.select("query_id", "cand_id", F.lit(weights[n] / whole).alias("w"), "distance")
        rows = one if rows is None else rows.union(one)
    sums = rows.groupBy("query_id", "cand_id").agg(F.count("*").alias("spaces"), F.sum(F.col("w") * F.col("distance")).alias("d"), F.sum("w").alias("w"))
    return sums.select("query_id", "cand_id", "spaces", (F.col("d") + (1 - F.col("w")) * missing).alias("distance"))
