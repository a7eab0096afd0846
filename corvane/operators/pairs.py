"""Candidate pairs by blocking, and tiered scoring of pairs of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.blocking import hamming, hamming_join, met, self_block  # noqa: F401
from corvane.runtime import spread


def hash_of_hex(h: Column) -> Column:
    """64-bit hash of up to 16 hex digits; anything else is null."""
    return F.when(h.rlike("^[0-9a-fA-F]{1,16}$"), F.conv(h, 16, -10).cast("long"))


def first_source(*parts: tuple[str, DataFrame]) -> DataFrame:
    """Union of candidates (a, b, ...) in canonical order; the first source that has a pair names it. Further columns, which some sources
    have, keep their largest value."""
    rows, more = None, []
    for order, (name, df) in enumerate(parts):
        rest = [c for c in df.columns if c not in ("a", "b")]
        more += [c for c in rest if c not in more]
        one = df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(order).alias("_o"), F.lit(name).alias("source"), *rest)
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    return rows.groupBy("a", "b").agg(F.min_by("source", "_o").alias("source"), *(F.max(c).alias(c) for c in more))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two arrays as sets; zero where either is empty or null."""
    both = F.size(F.array_union(a, b))
    some = (F.size(F.coalesce(a, F.array())) > 0) & (F.size(F.coalesce(b, F.array())) > 0)
    return F.when(some, F.size(F.array_intersect(a, b)) / F.nullif(both, F.lit(0))).otherwise(0.0)


def days_between(a: Column, b: Column) -> Column:
    """Whole days between two date strings; null where one is no date."""
    d = lambda c: F.try_to_timestamp(c, F.lit("yyyy-M-d")).cast("date")
    return F.abs(F.datediff(d(a), d(b)))


def metadata_score(days: Column, overlap: Column, any_a: Column, any_b: Column, same_group: Column, dur_a: Column, dur_b: Column) -> Column:
    """0 to 60: date and entities first, group as a boost, a large gap in duration as a penalty."""
    same, close, exact, part = days == 0, days <= 7, (overlap == 1.0) & any_a, overlap >= 0.5
    base = (
        F.when(same & exact, 45.0).when(same & part, 35.0).when(close & exact, 35.0).when(exact, 25.0)
        .when(same & (any_a | any_b), 20.0).when(part, 15.0).otherwise(0.0)
    )
    ratio = F.least(dur_a, dur_b) / F.nullif(F.greatest(dur_a, dur_b), F.lit(0.0))
    known = (F.coalesce(dur_a, F.lit(0.0)) != 0) & (F.coalesce(dur_b, F.lit(0.0)) != 0)
    off = F.when(known & (ratio < 0.15), 20.0).when(known & (ratio < 0.30), 10.0).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(60.0), base + F.when(F.coalesce(same_group, F.lit(False)), 10.0).otherwise(0.0) - off))


def signature_scores(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """(a, b, shared, face_score) of pairs with a shared known entity; ``prints``: (id, entity, proportion), unknown ones dropped."""
    p = prints.where("entity <> 'unknown'")
    size = p.groupBy("id").agg(F.countDistinct("entity").alias("k"))
    x, y = p.select(F.col("id").alias("a"), "entity", F.col("proportion").alias("px")), p.select(F.col("id").alias("b"), "entity", F.col("proportion").alias("py"))
    both = met(met(pairs.select("a", "b"), x, "a"), y, ["b", "entity"]).groupBy("a", "b").agg(F.count("*").alias("shared"), F.avg(F.abs(F.col("px") - F.col("py"))).alias("diff"))
    both = met(met(both, size.select(F.col("id").alias("a"), F.col("k").alias("ka")), "a"), size.select(F.col("id").alias("b"), F.col("k").alias("kb")), "b")
    j = F.col("shared") / (F.col("ka") + F.col("kb") - F.col("shared"))
    score = F.least(F.lit(75.0), 60 * j + F.greatest(F.lit(0.0), 15 * (1 - 4 * F.col("diff"))))
    return both.select("a", "b", "shared", score.alias("face_score"))


def hash_score(d: Column) -> Column:
    return F.when(d <= 10, 85.0 - 6.5 * d).otherwise(0.0)


def pair_confidence(shared_id: Column, distance: Column, p: Column, face: Column, meta: Column) -> Column:
    """Unrounded confidence by tier: shared id, strong hash, hash with support, metadata and faces; null without a signal."""
    more, less = F.greatest(meta, face), F.least(meta, face)
    tier = (
        F.when(distance <= 4, p + F.least(meta * 0.15, F.lit(5.0)) + F.least(face * 0.1, F.lit(5.0)))
        .when(p > 0, F.when(more > 0, p + more * 0.4).otherwise(p * 0.6)).otherwise(more + less * 0.3)
    )
    return F.when(shared_id, 100.0).when((p > 0) | (face > 0) | (meta > 0), F.least(tier, F.lit(95.0)))


def band(confidence: Column) -> Column:
    return F.when(confidence >= 80, "High").when(confidence >= 50, "Likely").otherwise("Possible")


def size_text(n: Column, units: tuple[str, ...] = ("B", "KB", "MB", "GB", "TB", "PB")) -> Column:
    """Bytes in steps of 1024 with one decimal, halves to the even one; the last unit takes all that is larger."""
    out = F.lit(None).cast("string")
    for k, unit in reversed(list(enumerate(units))):
        fits = n.isNotNull() if k == len(units) - 1 else n < 1024.0 ** (k + 1)
        out = F.when(fits, F.format_string(f"%.1f {unit}", F.bround(n / 1024.0**k, 1))).otherwise(out)
    return out


def clock_text(seconds: Column) -> Column:
    """H:MM:SS from an hour on, else M:SS."""
    s = F.floor(seconds).cast("int")
    h, m, x = F.floor(s / 3600).cast("int"), F.floor(s % 3600 / 60).cast("int"), s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, x)).otherwise(F.format_string("%d:%02d", m, x))


def file_quality(width: Column, height: Column, rate: Column, codec: Column) -> Column:
    c = F.lower(F.coalesce(codec, F.lit("")))
    bonus = F.when(c.rlike("hevc|h265|x265"), 100).when(c.rlike("h264|avc|x264"), 50).otherwise(0)
    z = lambda x: F.coalesce(x.cast("long"), F.lit(0))
    return (F.floor(z(width) * z(height) / 10000) + F.floor(z(rate) / 1000000) + bonus).cast("long")


def keepers(files: DataFrame, group: str) -> DataFrame:
    """``files`` (group, file_id, size, quality) by group of two or more: keeper (best quality, first id), total and savings."""
    w = Window.partitionBy(group)
    ranked = files.withColumn("_k", F.row_number().over(w.orderBy(F.desc("quality"), "file_id", F.desc("size")))).withColumn("_n", F.count("*").over(w))
    return ranked.where("_n > 1").groupBy(group).agg(
        F.max(F.when(F.col("_k") == 1, F.col("file_id"))).alias("keeper"), F.count("*").alias("files"), F.sum("size").alias("total"),
        F.sum(F.when(F.col("_k") > 1, F.col("size")).otherwise(0)).alias("savings"),
    )


def shared_id_groups(entities: DataFrame) -> DataFrame:
    """``entities`` (endpoint, ext_id, id, content): groups of two distinct ids or more; the keeper has most content."""
    agg = entities.groupBy("endpoint", "ext_id").agg(F.countDistinct("id").alias("members"), F.max_by("id", F.struct("content", -F.col("id"))).alias("keeper"))
    return agg.where("members >= 2")


def print_scores(local: DataFrame, remote: DataFrame, rows: int) -> DataFrame:
    """Local hashes (item_id, hash, algorithm, total, duration) against remote ones (match_id, hash, duration, submissions).

    One row (item_id, match_id) with the share of local hashes found, whether an exact algorithm agrees, the mean
    difference of durations, and whether the match is alone and strong enough. Both sides have about ``rows`` rows each.
    """
    remote = remote.select("match_id", "hash", F.col("duration").alias("rd"), "submissions")
    j = spread(spread(local, rows, "hash").join(spread(remote, rows, "hash"), "hash"), 2 * rows, "item_id")
    agg = j.groupBy("item_id", "match_id").agg(
        F.countDistinct("hash").alias("n"), F.first("total").alias("total"), F.bool_or(F.col("algorithm").isin("MD5", "OSHASH")).alias("exact"),
        F.avg(F.when((F.col("rd") > 0) & (F.col("duration") > 0), F.abs(F.col("rd") - F.col("duration")))).alias("diff"), F.sum("submissions").alias("submissions"),
    )
    percent = F.round(F.col("n") * 100.0 / F.col("total"), 1)
    agg = agg.withColumn("percent", percent).withColumn("agree", F.coalesce(F.col("diff") <= 5, F.lit(True)))
    alone = F.count("*").over(Window.partitionBy("item_id")) == 1
    return agg.withColumn("high", alone & (F.col("n") >= 2) & (F.col("percent") >= 66))
