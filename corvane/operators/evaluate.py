"""Measures of identification against expected entities, and stratified samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.runtime import spread


def compare(expected: DataFrame, found: DataFrame, rows: int) -> DataFrame:
    """(item_id, tp, fn, fp) of the distinct (item_id, entity) pairs of both sides, which have about ``rows`` rows each; a null item or entity is found nowhere on the other side."""
    side = lambda df, e: df.select("item_id", "entity", F.lit(e).alias("e"), F.lit(not e).alias("f"))
    both = spread(side(expected, True).union(side(found, False)), 2 * rows, "item_id")
    alone = F.when(F.col("item_id").isNull() | F.col("entity").isNull(), F.col("e"))
    j = both.groupBy("item_id", "entity", alone.alias("alone")).agg(F.bool_or("e").alias("e"), F.bool_or("f").alias("f"))
    n = lambda c: F.count_if(c)
    return j.groupBy("item_id").agg(n(F.col("e") & F.col("f")).alias("tp"), n(~F.col("f")).alias("fn"), n(~F.col("e")).alias("fp"))


def metrics(tp: Column, fn: Column, fp: Column) -> dict[str, Column]:
    safe = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return {"accuracy": safe(tp, tp + fn), "precision": safe(tp, tp + fp)}


def totals(per_item: DataFrame, *by: str) -> DataFrame:
    g = per_item.groupBy(*by).agg(F.sum("tp").alias("tp"), F.sum("fn").alias("fn"), F.sum("fp").alias("fp"))
    return g.select(*by, "tp", "fn", "fp", *(F.round(c, 6).alias(k) for k, c in metrics(F.col("tp"), F.col("fn"), F.col("fp")).items()))


def expected_results(expected: DataFrame, ranked: DataFrame) -> DataFrame:
    """For each expected (item_id, entity) its rank, or the first three that came instead; ``ranked`` has item_id, entity, rank."""
    first = ranked.where("rank <= 3").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("rank", "entity"))).alias("top"))
    j = expected.join(ranked.select("item_id", "entity", "rank"), ["item_id", "entity"], "left").join(first, "item_id", "left")
    beaten = F.when(F.col("rank").isNull(), F.array_join(F.transform("top", lambda t: t["entity"].cast("string")), ","))
    return j.select("item_id", "entity", "rank", F.coalesce(beaten, F.lit("")).alias("beaten_by"))


def failure(detected: Column, on_file: Column, rank: Column) -> Column:
    return F.when(~detected, "not_detected").when(on_file < 3, "insufficient_coverage").when(rank > 1, "similar_won").otherwise("low_confidence")


def coverage_bucket(n: Column) -> Column:
    return F.when(n <= 2, "0-2").when(n <= 5, "3-5").when(n <= 9, "6-9").otherwise("10+")


def stratified(rows: DataFrame, tier: str, id_col: str, count: int, seed: int = 7) -> DataFrame:
    """``count`` rows over the tiers: an equal share each, the remainder to the first tiers by name, at most what there is.

    Chosen by a hash of id and seed, so the sample is the same however the rows are dealt.
    """
    names = sorted(r[0] for r in rows.select(tier).distinct().collect())  # tiers, a handful
    base, extra = divmod(count, max(1, len(names)))
    share = F.lit(base)
    for t in names[:extra]:
        share = F.when(F.col(tier) == t, base + 1).otherwise(share)
    w = Window.partitionBy(tier).orderBy(F.md5(F.concat_ws(":", F.lit(seed), id_col)), id_col)
    return rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= share).drop("_k")
