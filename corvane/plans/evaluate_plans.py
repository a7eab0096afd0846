"""Queries for evaluation and kernels: expected and found suppliers of ``orders``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.functions import kernels as K
from corvane.operators import evaluate as E
from corvane.runtime import table
from corvane.sources.derived import CTES, with_ctes

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


CTES["expected"] = ((), "SELECT DISTINCT l_orderkey AS item_id, l_suppkey AS entity FROM lineitem")
CTES["found"] = (
    (),
    """SELECT item_id, entity, row_number() OVER (PARTITION BY item_id ORDER BY conf DESC, entity) AS rank, conf FROM (
  SELECT l_orderkey AS item_id, CASE WHEN l_linenumber % 5 = 0 THEN l_suppkey + 1 ELSE l_suppkey END AS entity, max(l_quantity) / 50 AS conf FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL)""",
)
CTES["per_item"] = (
    ("expected", "found"),
    """SELECT item_id, count(*) FILTER (WHERE e IS NOT NULL AND f IS NOT NULL) AS tp, count(*) FILTER (WHERE f IS NULL) AS fn, count(*) FILTER (WHERE e IS NULL) AS fp FROM
  (SELECT item_id, entity, 1 AS e FROM expected) FULL JOIN (SELECT DISTINCT item_id, entity, 1 AS f FROM found) USING (item_id, entity) GROUP BY item_id""",
)
_TIER = "CASE WHEN o_totalprice >= 400000 THEN '4k' WHEN o_totalprice >= 250000 THEN '1080p' WHEN o_totalprice >= 100000 THEN '720p' ELSE '480p' END"
_M = "CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(fp) AS BIGINT) AS fp, round(coalesce(sum(tp) / nullif(sum(tp) + sum(fn), 0), 0.0), 6) AS accuracy, round(coalesce(sum(tp) / nullif(sum(tp) + sum(fp), 0), 0.0), 6) AS precision"


def expected(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.col("l_suppkey").alias("entity")).distinct()


_ENTITY = "if(l_linenumber % 5 = 0, l_suppkey + 1, l_suppkey)"


def found(spark, sf):
    g = table(spark, sf, "lineitem").where("l_returnflag <> 'R'").groupBy(F.col("l_orderkey").alias("item_id"), F.expr(_ENTITY).alias("entity")).agg((F.max("l_quantity") / 50).alias("conf"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("conf"), "entity")))


def per_item(spark, sf):
    li = table(spark, sf, "lineitem")
    item = F.col("l_orderkey").alias("item_id")
    return E.compare(li.select(item, F.col("l_suppkey").alias("entity")), li.where("l_returnflag <> 'R'").select(item, F.expr(_ENTITY).alias("entity")), li.count())


def tiers(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("item_id"), F.expr(_TIER).alias("tier"))


@query("a11_set_comparison", with_ctes("per_item", tail="SELECT item_id, tp, fn, fp FROM per_item"))
def a11(spark, sf):
    return per_item(spark, sf)


@query("a09_metrics", with_ctes("per_item", tail=f"SELECT {_M} FROM per_item"))
def a09(spark, sf):
    return E.totals(per_item(spark, sf))


@query("a10_a17_j25_metrics_by_tier", with_ctes("per_item", tail=f"SELECT tier, {_M} FROM per_item JOIN (SELECT o_orderkey AS item_id, {_TIER} AS tier FROM orders) USING (item_id) GROUP BY tier"))
def a10(spark, sf):
    return E.totals(per_item(spark, sf).join(tiers(spark, sf), "item_id"), "tier")


@query("a12_top_n_and_gap", with_ctes("expected", "found", tail="""SELECT count(*) FILTER (WHERE ok AND rank <= 2) AS in_top, round(CASE WHEN count(*) FILTER (WHERE ok) = 0 OR count(*) FILTER (WHERE NOT ok) = 0 THEN 0.0 ELSE avg(conf) FILTER (WHERE ok) - avg(conf) FILTER (WHERE NOT ok) END, 6) AS gap
FROM (SELECT f.*, e.entity IS NOT NULL AS ok FROM found f LEFT JOIN expected e USING (item_id, entity))"""))
def a12(spark, sf):
    j = found(spark, sf).join(expected(spark, sf).withColumn("e", F.lit(1)), ["item_id", "entity"], "left").withColumn("ok", F.col("e").isNotNull())
    gap = F.avg(F.when(F.col("ok"), F.col("conf"))) - F.avg(F.when(~F.col("ok"), F.col("conf")))
    return j.agg(F.count_if(F.col("ok") & (F.col("rank") <= 2)).alias("in_top"), F.round(F.coalesce(gap, F.lit(0.0)), 6).alias("gap"))


@query("a13_expected_results", with_ctes("expected", "found", tail="""SELECT item_id, entity, rank, coalesce(CASE WHEN rank IS NULL THEN top END, '') AS beaten_by FROM expected LEFT JOIN (SELECT item_id, entity, rank FROM found) USING (item_id, entity)
LEFT JOIN (SELECT item_id, string_agg(entity, ',' ORDER BY rank) AS top FROM found WHERE rank <= 3 GROUP BY item_id) USING (item_id)"""))
def a13(spark, sf):
    return E.expected_results(expected(spark, sf), found(spark, sf))


@query("a14_a24_failure_classes", with_ctes("expected", "found", tail="""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN item_id NOT IN (SELECT item_id FROM found) THEN 'not_detected' WHEN k < 3 THEN 'insufficient_coverage' WHEN rank > 1 THEN 'similar_won' ELSE 'low_confidence' END AS reason
FROM expected LEFT JOIN (SELECT item_id, entity, rank FROM found) USING (item_id, entity) JOIN (SELECT entity, count(*) % 6 AS k FROM expected GROUP BY 1) USING (entity) WHERE rank IS NULL OR rank > 1) GROUP BY 1"""))
def a14(spark, sf):
    e, f = expected(spark, sf), found(spark, sf)
    on_file = e.groupBy("entity").agg((F.count("*") % 6).alias("k"))
    seen = f.select("item_id").distinct().withColumn("seen", F.lit(True))
    j = e.join(f.select("item_id", "entity", "rank"), ["item_id", "entity"], "left").where("rank is null or rank > 1").join(on_file, "entity").join(seen, "item_id", "left")
    return j.groupBy(E.failure(F.coalesce("seen", F.lit(False)), F.col("k"), F.col("rank")).alias("reason")).agg(F.count("*").alias("n"))


@query("a15_a16_outcomes", with_ctes("per_item", tail="SELECT CASE WHEN fn = 0 AND tp > 0 THEN 'full' WHEN tp > 0 THEN 'partial' ELSE 'zero' END AS outcome, fp >= 2 AS many_wrong, CASE WHEN tp + fn <= 2 THEN '0-2' WHEN tp + fn <= 5 THEN '3-5' WHEN tp + fn <= 9 THEN '6-9' ELSE '10+' END AS bucket, count(*) AS n FROM per_item GROUP BY ALL"))
def a15(spark, sf):
    out = F.when((F.col("fn") == 0) & (F.col("tp") > 0), "full").when(F.col("tp") > 0, "partial").otherwise("zero")
    return per_item(spark, sf).groupBy(out.alias("outcome"), (F.col("fp") >= 2).alias("many_wrong"), E.coverage_bucket(F.col("tp") + F.col("fn")).alias("bucket")).agg(F.count("*").alias("n"))


_CUTS = (0.2, 0.4, 0.6, 0.8)


def sweep(spark, sf):
    """Metrics at several cut-offs from one pass: cumulative counts by cut, the items are not joined again."""
    cuts = F.explode(F.array(*map(F.lit, _CUTS)))
    f = found(spark, sf).select("item_id", "entity", "conf").join(expected(spark, sf).withColumn("e", F.lit(1)), ["item_id", "entity"], "full_outer")
    f = f.withColumn("cut", cuts).withColumn("hit", F.col("conf").isNotNull() & (F.col("conf") >= F.col("cut")))
    g = f.groupBy("cut").agg(F.count_if(F.col("hit") & F.col("e").isNotNull()).alias("tp"), F.count_if(~F.col("hit") & F.col("e").isNotNull()).alias("fn"), F.count_if(F.col("hit") & F.col("e").isNull()).alias("fp"))
    return E.totals(g, "cut")


CTES["sweep"] = (
    ("expected", "found"),
    f"""SELECT cut, {_M} FROM (SELECT cut, count(*) FILTER (WHERE hit AND e IS NOT NULL) AS tp, count(*) FILTER (WHERE NOT hit AND e IS NOT NULL) AS fn, count(*) FILTER (WHERE hit AND e IS NULL) AS fp FROM (
  SELECT cut, e, coalesce(conf >= cut, false) AS hit FROM (SELECT item_id, entity, conf FROM found) FULL JOIN (SELECT item_id, entity, 1 AS e FROM expected) USING (item_id, entity),
  (VALUES (0.2::DOUBLE), (0.4::DOUBLE), (0.6::DOUBLE), (0.8::DOUBLE)) v(cut)) GROUP BY cut) GROUP BY cut""",
)


@query("a18_a20_threshold_sweep", with_ctes("sweep", tail="SELECT cut, tp, fn, fp, accuracy, precision FROM sweep"))
def a20(spark, sf):
    return sweep(spark, sf)


@query("a21_best_of_sweep", with_ctes("sweep", tail="SELECT cut FROM sweep ORDER BY accuracy DESC, precision DESC LIMIT 1"))
def a21(spark, sf):
    return sweep(spark, sf).agg(F.max_by("cut", F.struct("accuracy", "precision")).alias("cut"))


@query("a19_j24_compare_runs", with_ctes("expected", "found", tail="""SELECT CASE WHEN a AND b THEN 'both' WHEN a THEN 'first' WHEN b THEN 'second' ELSE 'neither' END AS by, count(*) AS n FROM (
  SELECT coalesce(conf >= 0.3, false) AS a, coalesce(rank = 1, false) AS b FROM expected LEFT JOIN found USING (item_id, entity)) GROUP BY 1"""))
def a19(spark, sf):
    j = expected(spark, sf).join(found(spark, sf), ["item_id", "entity"], "left")
    a, b = F.coalesce(F.col("conf") >= 0.3, F.lit(False)), F.coalesce(F.col("rank") == 1, F.lit(False))
    return j.groupBy(F.when(a & b, "both").when(a, "first").when(b, "second").otherwise("neither").alias("by")).agg(F.count("*").alias("n"))


@query("a22_frame_quality", "SELECT l_orderkey AS item_id, round(sum(l_discount * sqrt(l_quantity * l_linenumber)), 6) AS quality FROM lineitem GROUP BY 1")
def a22(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("item_id")).agg(F.round(F.sum(F.col("l_discount") * F.sqrt(F.col("l_quantity") * F.col("l_linenumber"))), 6).alias("quality"))


@query("p11_valid_items", "SELECT l_orderkey AS item_id FROM lineitem GROUP BY 1 HAVING NOT (max(l_quantity) < 20 AND max(l_extendedprice) < 30000) AND count(DISTINCT l_suppkey) >= 2 AND count(*) FILTER (WHERE l_tax > 0.07) = 0")
def p11(spark, sf):
    g = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("item_id")).agg(F.max("l_quantity").alias("w"), F.max("l_extendedprice").alias("h"), F.collect_set("l_suppkey").alias("es"), F.collect_list("l_tax").alias("t"))
    return g.where(~((F.col("w") < 20) & (F.col("h") < 30000)) & (F.size("es") >= 2) & F.forall("t", lambda x: x <= 0.07)).select("item_id")


@query("w07_w08_w09_stratified_sample", f"""WITH t AS (SELECT o_orderkey AS item_id, {_TIER} AS tier FROM orders), k AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY md5(concat('7:', item_id)), item_id) AS k, dense_rank() OVER (ORDER BY tier) AS d FROM t)
SELECT item_id, tier FROM k WHERE k <= 50 // 4 + CASE WHEN d <= 50 % 4 THEN 1 ELSE 0 END""")
def w08(spark, sf):
    return E.stratified(tiers(spark, sf), "tier", "item_id", 50)


def _grid(c):
    return F.array_join(F.transform(c, lambda x: F.format_string("%.3f", x)), " ")


def _seconds(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.floor(F.col("o_totalprice") / 100) * 0.5).alias("d"))


_D = "(SELECT o_orderkey AS id, floor(o_totalprice / 100) * 0.5::DOUBLE AS d FROM orders)"


@query("k01_even_grid", f"SELECT id, round(d * 0.05 + 3 * (d * 0.95 - d * 0.05) / 9, 6) AS fourth, 10 AS n FROM {_D}")
def k01(spark, sf):
    g = K.even_grid(F.col("d"), 10)
    return _seconds(spark, sf).select("id", F.round(F.get(g, F.lit(3)), 6).alias("fourth"), F.size(g).alias("n"))


@query("k02_burst_grid", f"SELECT id, round(greatest(0, least(d, d * 0.05 - 0.5)), 6) AS first, round(greatest(0, least(d, d * 0.95 + 0.5)), 6) AS last, 12 AS n FROM {_D}")
def k02(spark, sf):
    g = K.burst_grid(F.col("d"), 12, 4, 0.5)
    return _seconds(spark, sf).select("id", F.round(F.get(g, F.lit(0)), 6).alias("first"), F.round(F.element_at(g, -1), 6).alias("last"), F.size(g).alias("n"))


@query("k03_weighted_grid", f"SELECT id, round(CASE WHEN d >= 300 THEN 15.0 ELSE d * 0.05 END, 6) AS first, round(d * 0.95, 6) AS last, 40 AS n FROM {_D}")
def k03(spark, sf):
    g = K.weighted_grid(F.col("d"), 40)
    return _seconds(spark, sf).select("id", F.round(F.get(g, F.lit(0)), 6).alias("first"), F.round(F.element_at(g, -1), 6).alias("last"), F.size(g).alias("n"))


def boxes(spark, sf):
    x, y = F.expr("(l_partkey % 10) * 5.0D"), F.expr("(l_suppkey % 10) * 5.0D")
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("image"), F.expr("l_linenumber * 1000000 + l_partkey").alias("id"), (F.col("l_extendedprice") / 100000).alias("score"), x.alias("x1"), y.alias("y1"))
    return li.withColumn("x2", F.col("x1") + 20).withColumn("y2", F.col("y1") + 20)


_INSIDE = "greatest(0, least(o.x2, b.x2) - greatest(o.x1, b.x1)) * greatest(0, least(o.y2, b.y2) - greatest(o.y1, b.y1))"


@query("k04_non_maximum_suppression", f"""WITH RECURSIVE p AS (SELECT l_orderkey AS image, l_linenumber * 1000000 + l_partkey AS id, l_extendedprice / 100000 AS score, (l_partkey % 10) * 5.0::DOUBLE AS x1, (l_suppkey % 10) * 5.0::DOUBLE AS y1 FROM lineitem),
b AS (SELECT image, {{'id': id, 'score': score, 'x1': x1, 'y1': y1, 'x2': x1 + 20, 'y2': y1 + 20}} AS b, row_number() OVER (PARTITION BY image ORDER BY score DESC, id) AS nth FROM p),
st AS (SELECT image, nth, [b] AS kept FROM b WHERE nth = 1 UNION ALL SELECT b.image, b.nth, CASE WHEN len(list_filter(kept, lambda o: {_INSIDE} / ((o.x2 - o.x1) * (o.y2 - o.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - {_INSIDE}) > 0.45)) = 0 THEN list_append(kept, b.b) ELSE kept END
  FROM st JOIN b ON b.image = st.image AND b.nth = st.nth + 1)
SELECT image, k.id AS id, k.score AS score FROM (SELECT image, unnest(kept) AS k FROM st QUALIFY row_number() OVER (PARTITION BY image ORDER BY nth DESC) = 1)""".replace("b.x", "b.b.x").replace("b.y", "b.b.y"))
def k04(spark, sf):
    return K.suppress(boxes(spark, sf))


_IMG = "(SELECT l_orderkey AS id, l_linenumber AS line, 320.0::DOUBLE + l_partkey % 640 AS iw, 240.0::DOUBLE + l_suppkey % 480 AS ih, l_quantity AS q FROM lineitem)"


@query("k05_k07_letterbox", f"""SELECT id, line, q, round(greatest(0, least(iw, (320 - q - px) / r)) / iw, 12) AS x1, round(greatest(0, least(ih, (320 + q - py) / r)) / ih, 12) AS y2 FROM (
  SELECT *, (640 - round(iw * r)) / 2 AS px, (640 - round(ih * r)) / 2 AS py FROM (SELECT *, least(640 / ih, 640 / iw) AS r FROM {_IMG})) WHERE q / 50 * 0.8 >= 0.25""")
def k05(spark, sf):
    i = table(spark, sf, "lineitem").selectExpr("l_orderkey as id", "l_linenumber as line", "320.0D + l_partkey % 640 as iw", "240.0D + l_suppkey % 480 as ih", "l_quantity as q")
    r, px, py = K.letterbox(F.col("iw"), F.col("ih"), 640)
    c = K.unletterbox(F.lit(320.0), F.lit(320.0), F.col("q") * 2, F.col("q") * 2, r, px, py, F.col("iw"), F.col("ih"))
    return i.where("q / 50 * 0.8D >= 0.25D").select("id", "line", "q", F.round(c[0], 12).alias("x1"), F.round(c[3], 12).alias("y2"))


@query("k06_location_hint", """SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp, CASE WHEN h IS NULL THEN v WHEN v = 'torso' THEN concat(h, ' side') ELSE concat(h, ' ', v) END AS hint FROM (
  SELECT *, CASE WHEN cx < 0.4 THEN 'left' WHEN cx > 0.6 THEN 'right' END AS h, CASE WHEN cy < 0.4 THEN 'upper body' WHEN cy > 0.7 THEN 'lower body' ELSE 'torso' END AS v
  FROM (SELECT *, (l_partkey % 64) / 64.0::DOUBLE + 0.03125 AS cx, (l_suppkey % 64) / 64.0::DOUBLE + 0.03125 AS cy FROM lineitem))""")
def k06(spark, sf):
    hint = K.location_hint(F.expr("(l_partkey % 64) / 64.0D"), F.expr("(l_suppkey % 64) / 64.0D"), F.lit(0.0625), F.lit(0.0625))
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), hint.alias("hint"))


@query("k08_v28_pose_ratios", """WITH p AS (SELECT vec_id AS id, e, list_transform(e[19:27], lambda v: least(1.0::DOUBLE, 0.29::DOUBLE + abs(v) * 10)) AS vis FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)),
m AS (SELECT *, (e[1] + e[3]) / 2 AS sx, (e[2] + e[4]) / 2 AS sy, (e[5] + e[7]) / 2 AS hx, (e[6] + e[8]) / 2 AS hy, (e[9] + e[11]) / 2 AS ax, (e[10] + e[12]) / 2 AS ay FROM p WHERE list_min(vis) >= 0.3),
d AS (SELECT id, vis, sqrt((e[1] - e[3]) ** 2 + (e[2] - e[4]) ** 2) AS s, sqrt((e[5] - e[7]) ** 2 + (e[6] - e[8]) ** 2) AS h, sqrt((sx - hx) ** 2 + (sy - hy) ** 2) AS torso, sqrt((hx - ax) ** 2 + (hy - ay) ** 2) AS leg,
  sqrt((e[13] - e[15]) ** 2 + (e[14] - e[16]) ** 2) AS arms, sqrt((e[17] - ax) ** 2 + (e[18] - ay) ** 2) AS height FROM m)
SELECT id, round(CASE WHEN h > 0 THEN s / h ELSE 0 END, 6) AS shoulder_hip, round(CASE WHEN torso > 0 THEN leg / torso ELSE 0 END, 6) AS leg_torso, round(CASE WHEN height > 0 THEN arms / height ELSE 0 END, 6) AS span_height, round(list_sum(vis) / 9, 6) AS confidence FROM d""")
def k08(spark, sf):
    v = lambda k: F.get("embedding", F.lit(k)).cast("double")
    names = ["left_shoulder", "right_shoulder", "left_hip", "right_hip", "left_ankle", "right_ankle", "left_wrist", "right_wrist", "nose"]
    seen = F.array(*(F.least(F.lit(1.0), 0.29 + F.abs(v(18 + k)) * 10) for k in range(9)))
    marks = {n: (v(2 * k), v(2 * k + 1)) for k, n in enumerate(names)}
    told = {n: F.round(c, 6).alias(n) for n, c in K.pose_ratios(marks).items()}
    total = F.aggregate(seen, F.lit(0.0), lambda a, x: a + x)
    return table(spark, sf, "embeddings").where(F.array_min(seen) >= 0.3).select(F.col("vec_id").alias("id"), *told.values(), F.round(total / 9, 6).alias("confidence"))


@query("k09_padded_crop", "SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS part, CAST(greatest(0, floor(x - 2)) AS BIGINT) AS left, CAST(least(100, floor(x + 20 + 2)) AS BIGINT) AS right FROM (SELECT *, l_partkey % 90 AS x FROM lineitem)")
def k09(spark, sf):
    c = K.padded_crop(F.expr("l_partkey % 90"), F.lit(0), F.lit(20), F.lit(20), F.lit(100), F.lit(100))
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), c[0].cast("long").alias("left"), c[2].cast("long").alias("right"))


@query("k10_yaw", "SELECT vec_id AS id, round(degrees(atan2(e[1] - (e[2] + e[3]) / 2, abs(e[3] - e[2]) / 2)), 6) AS yaw FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)")
def k10(spark, sf):
    v = lambda k: F.get("embedding", F.lit(k)).cast("double")
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.round(K.yaw(v(0), v(1), v(2)), 6).alias("yaw"))


@query("k11_p04_resolution_tier", "SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS part, CASE WHEN greatest(w, h) >= 2160 THEN '4k' WHEN greatest(w, h) >= 1080 THEN '1080p' WHEN greatest(w, h) >= 720 THEN '720p' ELSE '480p' END AS tier FROM (SELECT *, l_quantity * 60 AS w, l_quantity * 34 AS h FROM lineitem) WHERE w >= 80 AND h >= 80")
def k11(spark, sf):
    w, h = F.col("l_quantity") * 60, F.col("l_quantity") * 34
    return table(spark, sf, "lineitem").where((w >= 80) & (h >= 80)).select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), K.resolution_tier(w, h).alias("tier"))


@query("u03_detections_union", "SELECT l_orderkey AS id, l_linenumber AS frame FROM lineitem UNION ALL SELECT o_orderkey, -1 FROM orders WHERE o_orderstatus = 'F'")
def u03(spark, sf):
    frames = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("frame"))
    shots = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.lit(-1).alias("frame"))
    return frames.unionByName(shots)
