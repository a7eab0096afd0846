"""From matches of single faces to people in an item: votes, clusters, and one-to-one assignment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.runtime import ship


def representative_frames(boxes: DataFrame, top: int = 3) -> tuple[DataFrame, DataFrame]:
    """``boxes`` (item_id, frame, area): the frame of the largest box, and the frames of the largest summed areas."""
    largest = boxes.groupBy("item_id").agg(F.max_by("frame", F.struct("area", -F.col("frame"))).alias("frame"))
    sums = boxes.groupBy("item_id", "frame").agg(F.sum("area").alias("area"))
    w = Window.partitionBy("item_id").orderBy(F.desc("area"), "frame")
    return largest, sums.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def frequency_vote(faces: DataFrame, max_distance: float, min_count: int, min_frames: int, min_confidence: float, top: int) -> DataFrame:
    """Entities seen often and well enough in an item; the score rewards distinct frames."""
    agg = faces.where(F.col("distance") <= max_distance).groupBy("item_id", "entity").agg(
        F.count("*").alias("n"), F.countDistinct("frame").alias("frames"), F.min("distance").alias("best"), F.avg("distance").alias("avg_distance")
    )
    kept = agg.where((F.col("n") >= min_count) & (F.col("frames") >= min_frames) & (1 - F.col("best") >= min_confidence))
    scored = kept.withColumn("score", (1 - F.col("best")) * (1 + 0.1 * (F.col("frames") - 1)))
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), "entity")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def cluster_faces(faces: DataFrame, limit: float = 0.6) -> DataFrame:
    """``faces`` (item_id, frame, face_id, vec) with cluster: in order of frame and id, each joins the nearest
    centroid (mean of raw members) within ``limit``, or starts a new one; ties go to the earlier cluster.

    The fold depends on the order, so an item's faces are worked together; an item is one video or gallery.
    """
    ship(faces.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["frame", "face_id"])
        sums, sizes, out = [], [], []
        for v in pdf["vec"]:
            v = np.asarray(v, np.float64)
            best, at = limit, -1
            for k, (s, n) in enumerate(zip(sums, sizes)):
                c = s / n
                norm = np.linalg.norm(v) * np.linalg.norm(c)
                d = 1.0 if norm == 0 else 1 - float(v @ c) / norm
                if d < best:
                    best, at = d, k
            if at < 0:
                sums.append(v.copy())
                sizes.append(1)
                at = len(sums) - 1
            else:
                sums[at] += v
                sizes[at] += 1
            out.append(at)
        return pdf[["item_id", "frame", "face_id"]].assign(cluster=np.array(out, np.int32))

    return faces.groupBy("item_id").applyInPandas(run, "item_id long, frame long, face_id long, cluster int")


def merge_clusters(clustered: DataFrame) -> DataFrame:
    """``clustered`` (item_id, cluster, face_id, entity, distance, rank) by merged cluster.

    A cluster's best is the entity of its nearest first match; clusters of one best become one, numbered by the
    first of them. Clusters without a match stay apart.
    """
    top = clustered.where("rank = 1 and entity is not null").groupBy("item_id", "cluster").agg(F.min_by("entity", F.struct("distance", "face_id")).alias("best"))
    all_ = clustered.select("item_id", "cluster").distinct().join(top, ["item_id", "cluster"], "left")
    key = F.coalesce(F.col("best"), F.concat(F.lit("#"), F.col("cluster")))
    return all_.withColumn("merged", F.min("cluster").over(Window.partitionBy("item_id", key)))


def cluster_scores(matches: DataFrame, sizes: DataFrame, top: int) -> DataFrame:
    """An entity's mean distance in a cluster over the root of its share of the cluster; ``matches`` (item_id, cluster, entity, distance)."""
    agg = matches.groupBy("item_id", "cluster", "entity").agg(F.avg("distance").alias("mean"), F.count("*").alias("n")).join(sizes, ["item_id", "cluster"])
    scored = agg.withColumn("score", F.col("mean") / F.sqrt(F.col("n") / F.col("size")))
    w = Window.partitionBy("item_id", "cluster").orderBy("score", "entity")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def assign_greedily(choices: DataFrame, keep_unknown: bool = True) -> DataFrame:
    """``choices`` (item_id, cluster, size, entity, score, rank): by size, each cluster takes its best entity not yet taken.

    Clusters whose entities are all taken get null. Order: size descending, cluster.
    """
    ship(choices.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        used: set = set()
        out = []
        for (_, cluster), part in sorted(pdf.groupby(["size", "cluster"]), key=lambda x: (-x[0][0], x[0][1])):
            free = [e for e in part.sort_values("rank")["entity"] if isinstance(e, str) and e not in used]
            if free:
                used.add(free[0])
            if free or keep_unknown:
                out.append((int(cluster), free[0] if free else None, ",".join(free[1:])))
        return pd.DataFrame(out, columns=["cluster", "entity", "alternatives"]).assign(item_id=pdf["item_id"].iloc[0])[["item_id", "cluster", "entity", "alternatives"]]

    return choices.groupBy("item_id").applyInPandas(run, "item_id long, cluster int, entity string, alternatives string")


def hybrid(votes: DataFrame, clusters: DataFrame, n_clusters: DataFrame, min_confidence: float, top: int) -> DataFrame:
    """Full outer join of votes (item_id, entity, best, frames) and cluster results (item_id, entity, distance, frames)."""
    v = votes.select("item_id", "entity", F.col("best").alias("dv"), F.col("frames").alias("fv"))
    c = clusters.select("item_id", "entity", F.col("distance").alias("dc"), F.col("frames").alias("fc"))
    j = v.join(c, ["item_id", "entity"], "full_outer")
    d, frames = F.least("dv", "dc"), F.greatest("fv", "fc")
    bonus = F.when(F.col("dv").isNotNull() & F.col("dc").isNotNull(), 0.25).otherwise(0.0)
    j = j.withColumn("distance", d).withColumn("frames", frames).withColumn("confidence", F.least(F.lit(1.0), 1 - d + bonus))
    j = j.where(F.col("confidence") >= min_confidence).withColumn("score", F.col("confidence") * (1 + 0.05 * (F.col("frames") - 1)))
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), "entity")
    limit = F.greatest(F.lit(2), F.least(F.lit(top), F.col("n_clusters")))
    return j.join(n_clusters, "item_id").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def gallery(faces: DataFrame) -> DataFrame:
    """First match of each face: entities in two images or more, or below 0.4 once."""
    agg = faces.where("rank = 1").groupBy("item_id", "entity").agg(F.countDistinct("frame").alias("images"), F.min("distance").alias("best"), F.avg("distance").alias("mean"))
    w = Window.partitionBy("item_id").orderBy(F.desc("images"), "best", "entity")
    return agg.where("images >= 2 or best < 0.4").withColumn("rank", F.row_number().over(w))


def fingerprint(faces: DataFrame) -> DataFrame:
    """(item_id, entity, n, proportion, confidence) from first matches."""
    agg = faces.where("rank = 1").groupBy("item_id", "entity").agg(F.count("*").alias("n"), F.avg(F.greatest(F.lit(0.0), 1 - F.col("distance"))).alias("confidence"))
    return agg.withColumn("proportion", F.col("n") / F.sum("n").over(Window.partitionBy("item_id")))
