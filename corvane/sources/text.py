"""Text sources and sinks: CSV, JSON and WebVTT; domains, batches and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def domain(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, "^[a-z]+://([^/:]+)", 1))
    return F.regexp_replace(host, "^(www|m)\\.", "")


def csv_round_trip(rows: DataFrame, path: str) -> DataFrame:
    rows.write.option("header", True).option("emptyValue", '""').csv(path)
    return rows.sparkSession.read.schema(rows.schema).option("header", True).option("emptyValue", "").option("nullValue", "\u0000").csv(path)


def json_round_trip(rows: DataFrame, path: str) -> DataFrame:
    rows.write.json(path)
    return rows.sparkSession.read.schema(rows.schema).json(path)


def ranks(df: DataFrame, by: str) -> DataFrame:
    """Global rank from 0 without one task for all rows: ranks within range partitions plus their offsets."""
    parts = df.repartitionByRange(by).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(by)) - 1)
    from corvane.runtime import materialise

    parts = materialise(parts, "ranks")
    sizes = sorted(map(tuple, parts.groupBy("_p").count().collect()))  # one row a partition
    starts, at = [], 0
    for p, n in sizes:
        starts.append((p, at))
        at += n
    known = df.sparkSession.createDataFrame(starts or [(-1, 0)], "_p int, _s long")
    return parts.join(F.broadcast(known), "_p").withColumn("rank", F.col("_s") + F.col("_i")).drop("_p", "_i", "_s")


def batches(df: DataFrame, by: str, size: int) -> DataFrame:
    return ranks(df, by).withColumn("batch", F.floor(F.col("rank") / size)).drop("rank")


def gaps(df: DataFrame, by: str) -> DataFrame:
    """(start, stop, missing) between consecutive numbers: lag within range partitions, and once across their edges."""
    from corvane.runtime import materialise

    parts = materialise(df.select(by).repartitionByRange(by).withColumn("_p", F.spark_partition_id()), "gaps")
    inner = parts.select(F.lag(by).over(Window.partitionBy("_p").orderBy(by)).alias("prev"), F.col(by).alias("k"))
    edges = sorted((a, b) for _, a, b in map(tuple, parts.groupBy("_p").agg(F.min(by), F.max(by)).collect()))  # one row a partition
    joints = df.sparkSession.createDataFrame([(x[1], y[0]) for x, y in zip(edges, edges[1:])] or [(0, 0)], "prev long, k long")
    both = inner.union(joints).where("k - prev > 1")
    return both.select((F.col("prev") + 1).alias("start"), (F.col("k") - 1).alias("stop"), (F.col("k") - F.col("prev") - 1).alias("missing"))


def _seconds(c: Column) -> Column:
    p = F.transform(F.split(F.trim(c), ":"), lambda x: x.try_cast("double"))
    return F.aggregate(p, F.lit(0.0), lambda a, x: a * 60 + x)


def parse_cues(lines: DataFrame) -> DataFrame:
    """``lines`` (item, line, text) of WebVTT: cues with start, stop in seconds and the frame x, y, w, h of the line after."""
    after = F.lead("text").over(Window.partitionBy("item").orderBy("line"))
    cues = lines.withColumn("next", after).where(F.col("text").contains("-->"))
    box = lambda k: F.regexp_extract("next", "#xywh=(\\d+),(\\d+),(\\d+),(\\d+)", k).try_cast("int")
    side = lambda k: _seconds(F.get(F.split("text", "-->"), F.lit(k)))
    out = cues.select("item", "line", side(0).alias("start"), side(1).alias("stop"), *(box(k).alias(n) for k, n in enumerate("xywh", 1)))
    return out.where("x is not null").withColumn("cue", F.row_number().over(Window.partitionBy("item").orderBy("line")) - 1)


def sample_cues(cues: DataFrame, most: int) -> DataFrame:
    """Every nth cue of an item where it has more than ``most``, cut at ``most``, with the time in the middle."""
    n = F.count("*").over(Window.partitionBy("item"))
    step = F.when(n > most, F.greatest(F.lit(1), F.floor(n / most))).otherwise(1)
    kept = cues.withColumn("_s", step).where(F.col("cue") % F.col("_s") == 0).where(F.floor(F.col("cue") / F.col("_s")) < most)
    return kept.withColumn("at", (F.col("start") + F.col("stop")) / 2).drop("_s")
