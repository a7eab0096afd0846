"""Queries for vector matching, fusion and voting, over the halves of ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import vector as V
from corvane.operators import voting as T
from corvane.runtime import materialise, table
from corvane.sources.derived import CTES, mapping, vectors, with_ctes

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def _recursive(*parts: str) -> str:
    """SQL of relations by name, a recursive one, and what comes after it."""
    *names, own, tail = parts
    return f"{with_ctes(*names).replace('WITH ', 'WITH RECURSIVE ', 1)},\n{own}\n{tail}"


def r6(c: str) -> F.Column:
    return F.round(c, 6).alias(c)


def near(spark: SparkSession, sf: str, side: str) -> DataFrame:
    v = vectors(spark, sf)
    q, i = v.where("id % 5 = 0"), v.where("id % 5 <> 0")
    found = V.nearest(q.select("id", F.col(side).alias("vec")), i.select("id", F.col(side).alias("vec")), 100)
    if side == "b":  # some queries stand for a broken model: all their distances are tiny
        found = found.withColumn("distance", F.col("distance") * F.when(F.col("query_id") % 10 == 0, 0.1).otherwise(1.0))
    return found


def both_sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    a, b = materialise(near(spark, sf, "a"), "near-a"), materialise(near(spark, sf, "b"), "near-b")
    sa, sb = (V.query_stats(n) for n in (a, b))
    ha, hb = (s.select("query_id", V.health(F.col("min_d"), F.col("var_d"), F.col("range_d")).alias(f"health_{k}")) for s, k in ((sa, "a"), (sb, "b")))
    j = ha.join(hb, "query_id", "full_outer").select("query_id", F.coalesce("health_a", F.lit("no_results")).alias("health_a"), F.coalesce("health_b", F.lit("no_results")).alias("health_b"))
    return a, b, j.withColumn("plan", V.strategy(F.col("health_a"), F.col("health_b")))


def fused(spark: SparkSession, sf: str) -> DataFrame:
    a, b, plans = both_sides(spark, sf)
    return V.fuse(a, b, plans, mapping(spark, sf))


def faces(spark: SparkSession, sf: str) -> DataFrame:
    m = V.top_matches(fused(spark, sf))
    return m.select(F.col("query_id").alias("face_id"), F.expr("query_id div 25").alias("item_id"), F.expr("query_id % 12").alias("frame"), "entity", "distance", "rank")


@query("v01_cosine_distance", with_ctes("vectors", tail="SELECT id, round(CASE WHEN list_inner_product(a, a) * list_inner_product(b, b) = 0 THEN 1 ELSE 1 - list_inner_product(a, b) / (sqrt(list_inner_product(a, a)) * sqrt(list_inner_product(b, b))) END, 6) AS distance FROM vectors"))
def v01(spark, sf):
    return vectors(spark, sf).select("id", F.round(V.cosine_distance(F.col("a"), F.col("b")), 6).alias("distance"))


@query("j10_v02_nearest", with_ctes("near_a", tail="SELECT query_id, cand_id, round(distance, 6) AS distance, rank FROM near_a WHERE rank <= 10"))
def v02(spark, sf):
    return near(spark, sf, "a").where("rank <= 10").select("query_id", "cand_id", r6("distance"), "rank")


@query("v03_query_stats", with_ctes("stats_b", tail="SELECT query_id, round(min_d, 6) AS min_d, round(var_d, 8) AS var_d, round(range_d, 6) AS range_d FROM stats_b"))
def v03(spark, sf):
    return V.query_stats(near(spark, sf, "b")).select("query_id", r6("min_d"), F.round("var_d", 8).alias("var_d"), r6("range_d"))


@query("v04_v05_health_and_strategy", with_ctes("plans", tail="SELECT query_id, health_a, health_b, plan FROM plans"))
def v04(spark, sf):
    return both_sides(spark, sf)[2]


@query("j11_v06_fused_distance", with_ctes("fused", tail="SELECT query_id, cand_id, entity, plan, round(distance, 6) AS distance FROM fused"))
def v06(spark, sf):
    return fused(spark, sf).select("query_id", "cand_id", "entity", "plan", r6("distance"))


@query("v07_match_counts", with_ctes("fused", tail="""SELECT query_id, CAST(count(da) AS BIGINT) AS in_a, CAST(count(db) AS BIGINT) AS in_b,
  CAST(sum(CASE WHEN da IS NOT NULL AND db IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS in_both, CAST(sum(CASE WHEN distance <= 0.8 THEN 1 ELSE 0 END) AS BIGINT) AS kept FROM fused GROUP BY query_id"""))
def v07(spark, sf):
    return fused(spark, sf).groupBy("query_id").agg(
        F.count("da").alias("in_a"), F.count("db").alias("in_b"), F.count_if(F.col("da").isNotNull() & F.col("db").isNotNull()).alias("in_both"), F.count_if(F.col("distance") <= 0.8).alias("kept")
    )


@query("v08_match_by_entity", with_ctes("near_a", "near_b", "mapping", tail="""SELECT query_id, entity, round(d, 6) AS distance, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, entity) AS rank FROM (
    SELECT query_id, entity, (x.d + y.d) / 2 AS d FROM (SELECT query_id, entity, max(distance) AS d FROM near_a JOIN mapping USING (cand_id) GROUP BY ALL) x
    JOIN (SELECT query_id, entity, max(distance) AS d FROM near_b JOIN mapping USING (cand_id) GROUP BY ALL) y USING (query_id, entity))) WHERE rank <= 5"""))
def v08(spark, sf):
    return V.match_by_entity(near(spark, sf, "a"), near(spark, sf, "b"), mapping(spark, sf), 5).select("query_id", "entity", r6("distance"), "rank")


@query("v09_fused_match", with_ctes("matches", tail="""SELECT query_id, cand_id, entity, round(distance, 6) AS distance, round(greatest(0, least(1, 1 - distance)), 6) AS confidence,
  round(coalesce(da, 0.0), 6) AS da, round(coalesce(db, 0.0), 6) AS db, rank FROM matches"""))
def v09(spark, sf):
    m = V.top_matches(fused(spark, sf))
    return m.select("query_id", "cand_id", "entity", r6("distance"), r6("confidence"), F.round(F.coalesce("da", F.lit(0.0)), 6).alias("da"), F.round(F.coalesce("db", F.lit(0.0)), 6).alias("db"), "rank")


@query("v10_p04_detections_to_matches", with_ctes("matches", tail="SELECT query_id // 25 AS item_id, CAST(count(DISTINCT query_id) AS BIGINT) AS faces, CAST(count(DISTINCT entity) AS BIGINT) AS entities FROM matches WHERE (query_id * 7) % 100 >= 30 GROUP BY 1"))
def v10(spark, sf):
    good = faces(spark, sf).where("(face_id * 7) % 100 >= 30")  # the detection's confidence, in hundredths
    return good.groupBy("item_id").agg(F.countDistinct("face_id").alias("faces"), F.countDistinct("entity").alias("entities"))


@query("v11_mark_similarity", with_ctes("near_b", "mapping", tail="SELECT query_id, entity, round(max(greatest(0.0, 1 - distance)), 6) AS similarity FROM near_b JOIN mapping USING (cand_id) WHERE rank <= 10 GROUP BY ALL"))
def v11(spark, sf):
    return V.mark_similarity(near(spark, sf, "b").where("rank <= 10"), mapping(spark, sf)).select("query_id", "entity", r6("similarity"))


_RERANK = """SELECT query_id, cand_id, round(score, 6) AS score, new_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS new_rank FROM (
    SELECT *, 1 / (1 + distance) * (CASE WHEN cand_id % 7 = 0 THEN 1.0 WHEN bd > 0.35 THEN 0.3 WHEN bd > 0.2 THEN 0.6 WHEN bd > 0.12 THEN 0.85 ELSE 1.0 END)
      * (CASE WHEN query_id % 3 = 0 THEN 1.0 WHEN query_id % 3 = 1 THEN CASE WHEN cand_id % 2 = 0 THEN 0.95 ELSE 1.0 END
         WHEN sim > 0.7 THEN 1.3 + (sim - 0.7) * (0.2 / 0.3) WHEN sim > 0.5 THEN 1.1 WHEN cand_id % 2 <> 0 THEN 0.7 ELSE 1.0 END) AS score
    FROM (SELECT *, abs((cand_id % 50) / 100.0 - (query_id % 40) / 100.0) AS bd, (cand_id % 101) / 100.0 AS sim FROM matches)))"""


@query("v12_v13_v14_rerank", with_ctes("matches", tail=_RERANK))
def v14(spark, sf):
    m = V.top_matches(fused(spark, sf))
    body = V.body_multiplier(F.when(F.col("cand_id") % 7 != 0, F.expr("(cand_id % 50) / 100.0D - (query_id % 40) / 100.0D")))
    mark = V.mark_multiplier(F.expr("query_id % 3 <> 0"), F.expr("query_id % 3 = 2"), F.expr("(cand_id % 101) / 100.0D"), F.expr("cand_id % 2 = 0"))
    return V.rerank(m, "query_id", body, mark, 10).select("query_id", "cand_id", r6("score"), "new_rank")


@query("v15_rerank_items", with_ctes("faces", tail="""SELECT item_id, entity, round(score, 6) AS score, new_rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, rank) AS new_rank FROM (
  SELECT item_id, entity, best, rank, 1 / (1 + best) * (CASE WHEN rank % 3 = 0 THEN 0.85 ELSE 1.0 END) AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY best, entity) AS rank FROM (SELECT item_id, entity, min(distance) AS best FROM faces GROUP BY ALL)))) WHERE new_rank <= 5"""))
def v15(spark, sf):
    from pyspark.sql import Window

    best = faces(spark, sf).groupBy("item_id", "entity").agg(F.min("distance").alias("distance"))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy("distance", "entity")))
    return V.rerank(best, "item_id", F.when(F.col("rank") % 3 == 0, 0.85).otherwise(1.0), F.lit(1.0), 5).select("item_id", "entity", r6("score"), "new_rank")


_BOXES = "SELECT vec_id // 25 AS item_id, vec_id % 12 AS frame, CAST((vec_id * 13) % 97 AS BIGINT) AS area FROM embeddings"


def boxes(spark, sf):
    return table(spark, sf, "embeddings").selectExpr("vec_id div 25 as item_id", "vec_id % 12 as frame", "(vec_id * 13) % 97 as area")


@query("v16_representative_frames", f"""WITH b AS ({_BOXES}), s AS (SELECT item_id, frame, sum(area) AS area FROM b GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY area DESC, frame) AS rank FROM s)
SELECT r.item_id, r.frame, CAST(area AS BIGINT) AS area, rank, largest FROM r JOIN (SELECT item_id, max_by(frame, area * 1000 - frame) AS largest FROM b GROUP BY item_id) USING (item_id) WHERE rank <= 3""")
def v16(spark, sf):
    largest, top = T.representative_frames(boxes(spark, sf))
    return top.join(largest.withColumnRenamed("frame", "largest"), "item_id").select("item_id", "frame", "area", "rank", "largest")


def clustered(spark, sf):
    v = vectors(spark, sf).where("id % 5 = 0").select(F.col("id").alias("face_id"), F.expr("id div 25").alias("item_id"), F.expr("id % 12").alias("frame"), F.concat("a", "b").alias("vec"))
    return T.cluster_faces(v, 0.95)


CTES["folded"] = (
    ("vectors",),
    """SELECT id // 25 AS item_id, id % 12 AS frame, id AS face_id, list_concat(a, b) AS v, row_number() OVER (PARTITION BY id // 25 ORDER BY id % 12, id) AS nth FROM vectors WHERE id % 5 = 0""",
)
#: The distances of a face from the sums of the clusters so far (a sum has its mean's direction), and the cluster that it joins.
_AWAY = """list_transform(sums, lambda s: CASE WHEN list_inner_product(s, s) * list_inner_product(f.v, f.v) = 0 THEN 1.0 ELSE 1 - list_inner_product(s, f.v) / sqrt(list_inner_product(s, s) * list_inner_product(f.v, f.v)) END)"""
_FOLD = f"""st AS (SELECT item_id, frame, face_id, nth, [v] AS sums, CAST(0 AS BIGINT) AS cluster FROM folded WHERE nth = 1
  UNION ALL SELECT item_id, frame, face_id, nth, CASE WHEN at_ > len(sums) THEN list_append(sums, v) ELSE list_transform(sums, lambda s, i: CASE WHEN i = at_ THEN list_transform(list_zip(s, v), lambda z: z[1] + z[2]) ELSE s END) END, at_ - 1
  FROM (SELECT f.*, sums, CASE WHEN list_min({_AWAY}) < 0.95 THEN list_position({_AWAY}, list_min({_AWAY})) ELSE len(sums) + 1 END AS at_ FROM st JOIN folded f ON f.item_id = st.item_id AND f.nth = st.nth + 1))"""


@query("v17_cluster_faces", _recursive("folded", _FOLD, "SELECT item_id, frame, face_id, cluster FROM st"))
def v17(spark, sf):
    return clustered(spark, sf)


@query("v18_merge_clusters", _recursive("folded", "faces", _FOLD, """, top AS (SELECT item_id, cluster, arg_min(entity, struct_pack(d := distance, f := face_id)) AS best FROM st JOIN (SELECT face_id, entity, distance FROM faces WHERE rank = 1) USING (face_id) GROUP BY ALL)
SELECT item_id, cluster, best, min(cluster) OVER (PARTITION BY item_id, coalesce(best, concat('#', cluster))) AS merged FROM (SELECT DISTINCT item_id, cluster FROM st) LEFT JOIN top USING (item_id, cluster)"""))
def v18(spark, sf):
    c, f = materialise(clustered(spark, sf), "clusters"), faces(spark, sf).where("rank = 1")
    return T.merge_clusters(c.join(f.select("face_id", "entity", "distance", "rank"), "face_id", "left"))


#: For queries whose clusters must be told by SQL too, an item's faces are grouped by label.
_BY_LABEL = "SELECT faces.*, CAST(label AS INT) AS cluster FROM faces JOIN vectors ON vectors.id = face_id"


def by_label(spark, sf):
    return faces(spark, sf).join(vectors(spark, sf).select(F.col("id").alias("face_id"), F.col("label").cast("int").alias("cluster")), "face_id")


@query("v19_cluster_scores", with_ctes("faces", "vectors", tail=f"""SELECT item_id, cluster, entity, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id, cluster ORDER BY score, entity) AS rank FROM (
    SELECT item_id, cluster, entity, avg(distance) / sqrt(count(*) / any_value(size)) AS score FROM ({_BY_LABEL}) JOIN (
      SELECT item_id, cluster, count(DISTINCT face_id) AS size FROM ({_BY_LABEL}) GROUP BY ALL) USING (item_id, cluster) GROUP BY item_id, cluster, entity)) WHERE rank <= 3"""))
def v19(spark, sf):
    m = materialise(by_label(spark, sf), "by-label")
    sizes = m.groupBy("item_id", "cluster").agg(F.countDistinct("face_id").alias("size"))
    return T.cluster_scores(m, sizes, 3).select("item_id", "cluster", "entity", r6("score"), "rank")


_VOTE = """SELECT item_id, entity, count(*) AS n, count(DISTINCT frame) AS frames, min(distance) AS best, avg(distance) AS avg_distance FROM faces WHERE distance <= {d} GROUP BY ALL
  HAVING count(*) >= {n} AND count(DISTINCT frame) >= {n} AND 1 - min(distance) >= {c}"""


@query("v20_frequency_vote", with_ctes("faces", tail=f"""SELECT item_id, entity, n, frames, round(score, 6) AS score, round(avg_distance, 6) AS avg_distance, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, entity) AS rank FROM (SELECT *, (1 - best) * (1 + 0.1 * (frames - 1)) AS score FROM ({_VOTE.format(d=0.8, n=2, c=0.2)}))) WHERE rank <= 5"""))
def v20(spark, sf):
    return T.frequency_vote(faces(spark, sf), 0.8, 2, 2, 0.2, 5).select("item_id", "entity", "n", "frames", r6("score"), r6("avg_distance"), "rank")


def _choices(m):
    from pyspark.sql import Window

    sizes = m.groupBy("item_id", "cluster").agg(F.countDistinct("face_id").alias("size"))
    votes = m.groupBy("item_id", "cluster", "entity").agg(((1 - F.min("distance")) * (1 + 0.1 * (F.countDistinct("frame") - 1))).alias("score"))
    w = Window.partitionBy("item_id", "cluster").orderBy(F.desc("score"), "entity")
    return votes.withColumn("rank", F.row_number().over(w)).join(sizes, ["item_id", "cluster"])


_GREEDY = f"""m AS ({_BY_LABEL}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id, cluster ORDER BY score DESC, entity) AS rank FROM (SELECT item_id, cluster, entity, (1 - min(distance)) * (1 + 0.1 * (count(DISTINCT frame) - 1)) AS score FROM m GROUP BY ALL)),
lists AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY size DESC, cluster) AS nth FROM (SELECT item_id, cluster, list(entity ORDER BY rank) AS wishes FROM ranked GROUP BY ALL)
  JOIN (SELECT item_id, cluster, count(DISTINCT face_id) AS size FROM m GROUP BY ALL) USING (item_id, cluster)),
st AS (SELECT item_id, cluster, nth, wishes AS free, wishes[1:1] AS used FROM lists WHERE nth = 1
  UNION ALL SELECT item_id, cluster, nth, free, list_concat(used, free[1:1]) FROM (
    SELECT l.item_id, l.cluster, l.nth, used, list_filter(wishes, lambda e: NOT list_contains(used, e)) AS free FROM st JOIN lists l ON l.item_id = st.item_id AND l.nth = st.nth + 1))
SELECT item_id, cluster, free[1] AS entity, array_to_string(free[2:], ',') AS alternatives FROM st"""
_GREEDY = _recursive("faces", "vectors", _GREEDY, "")


@query("v21_clustered_frequency", _GREEDY)
def v21(spark, sf):
    return T.assign_greedily(_choices(materialise(by_label(spark, sf), "by-label")))


@query("v23_unique_assignment", _GREEDY + " WHERE len(free) > 0")
def v23(spark, sf):
    return T.assign_greedily(_choices(materialise(by_label(spark, sf), "by-label")), keep_unknown=False)


@query("j13_v22_hybrid", with_ctes("faces", "vectors", tail=f"""SELECT item_id, entity, round(distance, 6) AS distance, CAST(frames AS BIGINT) AS frames, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, entity) AS rank FROM (
    SELECT *, confidence * (1 + 0.05 * (frames - 1)) AS score FROM (
      SELECT item_id, entity, least(v.best, c.best) AS distance, greatest(v.frames, c.frames) AS frames,
        least(1.0, 1 - least(v.best, c.best) + CASE WHEN v.best IS NOT NULL AND c.best IS NOT NULL THEN 0.25 ELSE 0 END) AS confidence
      FROM ({_VOTE.format(d=0.8, n=1, c=0.2)}) v FULL JOIN (
        SELECT item_id, entity, min(distance) AS best, count(DISTINCT frame) AS frames FROM faces WHERE rank <= 2 GROUP BY ALL) c USING (item_id, entity)) WHERE confidence >= 0.3))
JOIN (SELECT item_id, count(DISTINCT label) AS k FROM faces JOIN vectors ON id = face_id GROUP BY 1) USING (item_id) WHERE rank <= greatest(2, least(5, k))"""))
def v22(spark, sf):
    f = materialise(by_label(spark, sf), "by-label")
    votes = T.frequency_vote(f, 0.8, 1, 1, 0.2, 1 << 30)
    clusters = f.where("rank <= 2").groupBy("item_id", "entity").agg(F.min("distance").alias("distance"), F.countDistinct("frame").alias("frames"))
    n = f.groupBy("item_id").agg(F.countDistinct("cluster").alias("n_clusters"))
    return T.hybrid(votes, clusters, n, 0.3, 5).select("item_id", "entity", r6("distance"), "frames", r6("score"), "rank")


@query("v24_gallery", with_ctes("faces", tail="""SELECT item_id, entity, images, round(best, 6) AS best, round(mean, 6) AS mean, row_number() OVER (PARTITION BY item_id ORDER BY images DESC, best, entity) AS rank FROM (
  SELECT item_id, entity, count(DISTINCT frame) AS images, min(distance) AS best, avg(distance) AS mean FROM faces WHERE rank = 1 GROUP BY ALL HAVING count(DISTINCT frame) >= 2 OR min(distance) < 0.4)"""))
def v24(spark, sf):
    return T.gallery(faces(spark, sf)).select("item_id", "entity", "images", r6("best"), r6("mean"), "rank")


@query("v25_fingerprint", with_ctes("faces", tail="SELECT item_id, entity, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY item_id), 6) AS proportion, round(avg(greatest(0.0, 1 - distance)), 6) AS confidence FROM faces WHERE rank = 1 GROUP BY item_id, entity"))
def v25(spark, sf):
    return T.fingerprint(faces(spark, sf)).select("item_id", "entity", "n", r6("proportion"), r6("confidence"))


@query("v26_image_fingerprint", with_ctes("faces", tail="""SELECT item_id, entity, face_id, round((face_id % 640) / 640.0, 6) AS x, round((face_id % 480) / 480.0, 6) AS y FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id, entity ORDER BY face_id DESC) AS k FROM faces WHERE rank = 1) WHERE k = 1"""))
def v26(spark, sf):
    f = faces(spark, sf).where("rank = 1").groupBy("item_id", "entity").agg(F.max("face_id").alias("face_id"))  # the last of an image and entity wins
    return f.select("item_id", "entity", "face_id", F.expr("round((face_id % 640) / 640.0D, 6) as x"), F.expr("round((face_id % 480) / 480.0D, 6) as y"))


@query("v27_p06_confidence", with_ctes("near_a", tail="SELECT query_id, cand_id, round(greatest(0, least(1, 1 - distance)), 6) AS confidence FROM near_a WHERE distance <= 0.7"))
def v27(spark, sf):
    return near(spark, sf, "a").where("distance <= 0.7").select("query_id", "cand_id", F.round(V.clamp_confidence(F.col("distance")), 6).alias("confidence"))


@query("v28_normalised_average", with_ctes("vectors", tail="""SELECT id, round(list_inner_product(m, a) / sqrt(list_inner_product(m, m)), 6) AS along_a FROM (
  SELECT id, a, list_transform(list_zip(a, b), lambda x: (x[1] + x[2]) / 2) AS m FROM vectors)"""))
def v28(spark, sf):
    return vectors(spark, sf).select("id", F.round(V.dot(V.average_with_flip(F.col("a"), F.col("b")), F.col("a")), 6).alias("along_a"))


@query("v29_missing_images", with_ctes("matches", "mapping", tail="SELECT DISTINCT entity FROM matches WHERE entity NOT IN (SELECT entity FROM mapping WHERE cand_id % 11 = 0)"))
def v29(spark, sf):
    cached = mapping(spark, sf).where("cand_id % 11 = 0").select("entity")
    return V.top_matches(fused(spark, sf)).select("entity").distinct().join(cached, "entity", "left_anti")


@query("p05_index_gaps", with_ctes("near_a", "mapping", tail="SELECT query_id, count(*) AS mapped FROM near_a JOIN mapping USING (cand_id) GROUP BY query_id"))
def p05(spark, sf):
    return near(spark, sf, "a").join(mapping(spark, sf), "cand_id").groupBy("query_id").agg(F.count("*").alias("mapped"))


@query("j12_inner_of_two_lists", with_ctes("near_a", "near_b", tail="SELECT query_id, cand_id, round(a.distance, 6) AS da, round(b.distance, 6) AS db FROM near_a a JOIN near_b b USING (query_id, cand_id)"))
def j12(spark, sf):
    a, b = near(spark, sf, "a"), near(spark, sf, "b")
    return a.select("query_id", "cand_id", F.round("distance", 6).alias("da")).join(b.select("query_id", "cand_id", F.round("distance", 6).alias("db")), ["query_id", "cand_id"])


CTES["near_c"] = (
    ("vectors",),
    """SELECT query_id, cand_id, distance, rank FROM (SELECT q.id AS query_id, i.id AS cand_id, d AS distance, row_number() OVER (PARTITION BY q.id ORDER BY d, i.id) AS rank
  FROM (SELECT id, list_concat(a, b) AS v FROM vectors WHERE id % 5 = 0) q JOIN (SELECT id, list_concat(a, b) AS v FROM vectors WHERE id % 5 <> 0) i ON true,
  LATERAL (SELECT 1 - list_inner_product(q.v, i.v) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(i.v, i.v))) AS d)) WHERE rank <= 100""",
)


@query("s04_three_spaces", with_ctes("near_a", "near_b", "near_c", tail="""SELECT query_id, cand_id, count(*) AS spaces, round(sum(w * distance) + (1 - sum(w)) * 0.5, 6) AS distance FROM (
  SELECT query_id, cand_id, distance, 0.3 / 0.8 AS w FROM near_a UNION ALL SELECT query_id, cand_id, distance, 0.3 / 0.8 FROM near_b UNION ALL SELECT query_id, cand_id, distance, 0.2 / 0.8 FROM near_c) GROUP BY query_id, cand_id"""))
def s04(spark, sf):
    """Both halves and the whole vector, and a fourth space whose index is absent."""
    v = vectors(spark, sf).select("id", F.concat("a", "b").alias("vec"))
    c = V.nearest(v.where("id % 5 = 0"), v.where("id % 5 <> 0"), 100)
    found = {"a": near(spark, sf, "a"), "b": near(spark, sf, "b"), "c": c, "marks": None}
    return V.fuse_spaces(found, {"a": 0.3, "b": 0.3, "c": 0.2, "marks": 0.2}, 0.5).select("query_id", "cand_id", "spaces", r6("distance"))
