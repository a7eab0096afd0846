"""Queries for catalog reads, lookups, exports, sources and repairs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.runtime import materialise, scratch_dir, table
from corvane.sources import text as T
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


@query("s01_j01_j03_catalog_join", "SELECT s_suppkey AS id, s_name AS name, n_name AS country, r_name AS area FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey")
def j01(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    j = table(spark, sf, "supplier").join(n, F.col("n_nationkey") == F.col("s_nationkey")).join(r, F.col("r_regionkey") == F.col("n_regionkey"))
    return j.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("n_name").alias("country"), F.col("r_name").alias("area"))


@query("j02_alias_join", "SELECT DISTINCT a.p_partkey AS id FROM part a JOIN supplier ON lower(a.p_name) = lower(concat(CASE WHEN s_suppkey % 2 = 0 THEN 'SMALL ' ELSE 'red ' END, CASE WHEN s_suppkey % 3 = 0 THEN 'Ring' ELSE 'Widget' END))")
def j02(spark, sf):
    alias = F.expr("lower(concat(if(s_suppkey % 2 = 0, 'SMALL ', 'red '), if(s_suppkey % 3 = 0, 'Ring', 'Widget')))")
    s = table(spark, sf, "supplier").select(alias.alias("alias")).distinct()
    return table(spark, sf, "part").join(s, F.lower("p_name") == F.col("alias")).select(F.col("p_partkey").alias("id")).distinct()


@query("j04_w04_latest_by_confidence", "SELECT l_orderkey AS id, l_linenumber AS line, l_extendedprice AS confidence FROM (SELECT *, rank() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC) AS k FROM lineitem) WHERE k = 1")
def j04(spark, sf):
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"))
    li = table(spark, sf, "lineitem").withColumn("k", F.rank().over(w)).where("k = 1")  # rows that tie all stay
    return li.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_extendedprice").alias("confidence"))


@query("j05_fingerprints_with_faces", "SELECT o_orderkey AS id, count(DISTINCT l_suppkey) AS entities, CAST(coalesce(sum(l_quantity), 0) AS DOUBLE) AS faces FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1")
def j05(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    faces = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id"), "l_suppkey").agg(F.sum("l_quantity").alias("n"))
    m = o.join(faces, "id", "left").groupBy("id").agg(F.map_from_entries(F.collect_list(F.when(F.col("l_suppkey").isNotNull(), F.struct("l_suppkey", "n")))).alias("faces"))
    return m.select("id", F.size("faces").cast("long").alias("entities"), F.aggregate(F.map_values("faces"), F.lit(0.0), lambda a, x: a + x).alias("faces"))


@query("j17_j18_orphans", "SELECT c_custkey AS id FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey)")
def j17(spark, sf):
    o, s = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), table(spark, sf, "supplier").select(F.col("s_nationkey").alias("c_nationkey"))
    return table(spark, sf, "customer").join(o, "c_custkey", "left_semi").join(s, "c_nationkey", "left_anti").select(F.col("c_custkey").alias("id"))


_SOURCE = "CASE n_regionkey WHEN 0 THEN 'prime' WHEN 1 THEN 'second' ELSE 'other' END"


@query("j19_w02_w03_best_source", f"SELECT c_mktsegment AS key, id, source FROM (SELECT c_mktsegment, c_custkey AS id, {_SOURCE} AS source, row_number() OVER (PARTITION BY c_mktsegment ORDER BY CASE {_SOURCE} WHEN 'prime' THEN 1 WHEN 'second' THEN 2 ELSE 3 END, c_custkey) AS k FROM customer JOIN nation ON n_nationkey = c_nationkey) WHERE k = 1")
def j19(spark, sf):
    j = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("n_nationkey") == F.col("c_nationkey")).withColumn("source", F.expr(_SOURCE))
    place = F.expr("case source when 'prime' then 1 when 'second' then 2 else 3 end")
    return j.groupBy(F.col("c_mktsegment").alias("key")).agg(F.min_by(F.struct(F.col("c_custkey").alias("id"), "source"), F.struct(place, "c_custkey")).alias("b")).select("key", "b.*")


@query("j21_last_wins_lookup", "SELECT o_custkey AS ext, max(o_orderkey) AS id FROM orders GROUP BY 1")
def j21(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.explode(F.array("o_custkey")).alias("ext"))
    return o.groupBy("ext").agg(F.max_by("o_orderkey", "o_orderkey").alias("id"))


@query("s05_s13_updated_page", "SELECT o_orderkey AS id, count(*) OVER () AS total FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01' ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 25")
def s05(spark, sf):
    o = table(spark, sf, "orders").where("o_orderdate > timestamp '1998-01-01'")
    total = o.agg(F.count("*").alias("total"))
    return o.orderBy(F.desc("o_orderdate"), "o_orderkey").offset(25).limit(25).select(F.col("o_orderkey").alias("id")).join(F.broadcast(total))


@query("s06_s24_full_scans", "SELECT 'part' AS entity, count(*) AS n FROM part UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'customer', count(*) FROM customer")
def s06(spark, sf):
    one = lambda t: table(spark, sf, t).agg(F.lit(t).alias("entity"), F.count("*").alias("n"))
    return one("part").union(one("supplier")).union(one("customer"))


@query("s07_linked_to_endpoint", "SELECT o_custkey AS id, count(*) AS links FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1")
def s07(spark, sf):
    ids = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_list(F.struct(F.col("o_orderpriority").alias("endpoint"), F.col("o_orderkey").alias("ext_id"))).alias("ids"))
    of = lambda x: x["endpoint"] == "1-URGENT"
    return ids.where(F.exists("ids", of)).select("id", F.size(F.filter("ids", of)).cast("long").alias("links"))


@query("s08_multi_file", "SELECT l_orderkey AS id, count(*) AS files FROM lineitem GROUP BY 1 HAVING count(*) > 1 AND count(*) FILTER (WHERE l_returnflag = 'R') = 0")
def s08(spark, sf):
    g = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list("l_linenumber").alias("files"), F.collect_set("l_returnflag").alias("tags"))
    return g.where((F.size("files") > 1) & ~F.arrays_overlap("tags", F.array(F.lit("R")))).select("id", F.size("files").cast("long").alias("files"))


@query("s09_f01_f06_by_id", "SELECT o_orderkey AS id, o_totalprice AS price, l_linenumber AS line, l_partkey AS part FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey = 42")
def s09(spark, sf):
    o = table(spark, sf, "orders").where("o_orderkey = 42").join(table(spark, sf, "lineitem").where("l_orderkey = 42"), F.col("o_orderkey") == F.col("l_orderkey"))
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"))


@query("s10_f07_name_search", "SELECT p_partkey AS id, p_name AS name FROM part WHERE p_name ILIKE '%RING%' ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def s10(spark, sf):
    return table(spark, sf, "part").where(F.col("p_name").ilike("%RING%")).orderBy(F.desc("p_retailprice"), "p_partkey").limit(20).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))


@query("s11_reverse_lookup", "SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_suppkey = 5")
def s11(spark, sf):
    items = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_suppkey").alias("entities"))
    return items.where(F.array_contains("entities", F.lit(5).cast("long"))).select("id")


@query("s12_upstream_fetch", "SELECT l_orderkey AS id, l_linenumber AS line, p_name AS name FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_discount > 0.09")
def s12(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("name"))
    return table(spark, sf, "lineitem").where("l_discount > 0.09").join(p, "l_partkey").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), "name")


@query("s15_f10_f11_domains", r"SELECT domain, count(*) AS n, min(page_id) AS first FROM (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:]+)', 1)), '^(www|m)\.', '') AS domain FROM pages) GROUP BY 1")
def s15(spark, sf):
    uid = F.concat_ws(":", T.domain(F.col("url")), "page_id")
    p = table(spark, sf, "pages").select(F.split(uid, ":", 2).alias("u"))
    return p.groupBy(F.get("u", F.lit(0)).alias("domain")).agg(F.count("*").alias("n"), F.min(F.get("u", F.lit(1)).cast("long")).alias("first"))


@query("s16_csv_round_trip", "SELECT s_suppkey AS id, s_name AS name, printf('%.3f', s_acctbal) AS balance, CASE WHEN s_nationkey % 4 = 0 THEN '' ELSE CAST(s_nationkey AS VARCHAR) END AS nation FROM supplier")
def s16(spark, sf):
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.format_string("%.3f", "s_acctbal").alias("balance"), F.when(F.col("s_nationkey") % 4 != 0, F.col("s_nationkey").cast("string")).otherwise("").alias("nation"))
    return T.csv_round_trip(rows, scratch_dir(spark, "csv"))


@query("s03_s17_json_round_trip", "SELECT n_nationkey AS id, n_name AS name, r_name AS area FROM nation JOIN region ON r_regionkey = n_regionkey")
def s17(spark, sf):
    rows = table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("r_name").alias("area"))
    return T.json_round_trip(rows, scratch_dir(spark, "json"))


@query("s18_f13_dense_index", "SELECT i AS at, v.id FROM (SELECT unnest(range(0, (SELECT max(vec_id) + 1 FROM embeddings))) AS i) LEFT JOIN (SELECT vec_id, concat('catalog.example:', vec_id % 50) AS id FROM embeddings WHERE vec_id % 37 <> 0) v ON vec_id = i")
def s18(spark, sf):
    e = table(spark, sf, "embeddings")
    known = e.where("vec_id % 37 <> 0").select(F.col("vec_id").alias("at"), F.concat(F.lit("catalog.example:"), F.expr("vec_id % 50")).alias("id"))
    top = e.agg(F.max("vec_id")).first()[0]
    return spark.range(0, top + 1).withColumnRenamed("id", "at").join(known, "at", "left")


@query("f14_metadata_map", "SELECT concat('catalog.example:', s_suppkey) AS uid, s_name AS name, n_name AS country, count(*) AS face_count FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN lineitem ON l_suppkey = s_suppkey GROUP BY ALL")
def f14(spark, sf):
    faces = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("face_count"))
    j = table(spark, sf, "supplier").join(faces, "s_suppkey").join(F.broadcast(table(spark, sf, "nation")), F.col("n_nationkey") == F.col("s_nationkey"))
    return j.select(F.concat(F.lit("catalog.example:"), "s_suppkey").alias("uid"), F.col("s_name").alias("name"), F.col("n_name").alias("country"), "face_count")


@query("f08_ordered_batches", "SELECT (row_number() OVER (ORDER BY c_custkey) - 1) // 100 AS batch, c_custkey AS id FROM customer")
def f08(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return T.batches(c, "id", 100)


@query("f09_count_by_uid", "SELECT s_suppkey AS id, coalesce(n, 0) AS face_count FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45 GROUP BY 1) ON l_suppkey = s_suppkey")
def f09(spark, sf):
    n = table(spark, sf, "lineitem").where("l_returnflag = 'R' and l_quantity > 45").groupBy(F.col("l_suppkey").alias("id")).agg(F.count("*").alias("n"))
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id")).join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("face_count"))


@query("f12_a04_a05_info", "SELECT (SELECT count(*) FROM supplier) AS entities, (SELECT count(*) FROM embeddings) AS vectors, (SELECT max(vec_id) FROM embeddings) AS max_index, (SELECT count(DISTINCT n_regionkey) FROM nation) AS endpoints")
def f12(spark, sf):
    s = table(spark, sf, "supplier").agg(F.count("*").alias("entities"))
    e = table(spark, sf, "embeddings").agg(F.count("*").alias("vectors"), F.max("vec_id").alias("max_index"))
    n = table(spark, sf, "nation").agg(F.countDistinct("n_regionkey").alias("endpoints"))
    return s.join(e).join(n)


@query("a06_mark_info", """SELECT id, CAST(count(DISTINCT loc) AS BIGINT) AS locations, string_agg(DISTINCT loc, ',' ORDER BY loc) AS names FROM (SELECT user_id AS id, lower(event_type) AS loc FROM events WHERE event_type <> 'error'
UNION ALL SELECT user_id, concat('k', CAST(json_extract_string(props, '$.k') AS INT) % 4) FROM events) GROUP BY id""")
def a06(spark, sf):
    e = table(spark, sf, "events")
    text = e.where("event_type <> 'error'").select(F.col("user_id").alias("id"), F.lower("event_type").alias("loc"))
    hints = e.select("user_id", F.concat(F.lit("k"), F.from_json("props", "k int")["k"] % 4))
    return text.union(hints).groupBy("id").agg(F.countDistinct("loc").alias("locations"), F.array_join(F.sort_array(F.collect_set("loc")), ",").alias("names"))


@query("a07_count_repair", "SELECT o_orderkey AS id, stored, coalesce(n, 0) AS actual FROM (SELECT o_orderkey, o_orderkey % 8 AS stored FROM orders) LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE stored <> coalesce(n, 0)")
def a07(spark, sf):
    n = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("n"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 8).alias("stored"))
    return o.join(n, "id", "left").select("id", "stored", F.coalesce("n", F.lit(0)).alias("actual")).where("stored <> actual")


@query("a08_joined_urls", "SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, string_agg(url, '|' ORDER BY url) AS urls FROM pages GROUP BY 1")
def a08(spark, sf):
    return table(spark, sf, "pages").groupBy(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host")).agg(F.array_join(F.sort_array(F.collect_list("url")), "|").alias("urls"))


@query("w01_gaps", """WITH k AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 7 <> 0), g AS (SELECT lag(k) OVER (ORDER BY k) AS prev, k FROM k)
SELECT prev + 1 AS start, k - 1 AS stop, k - prev - 1 AS missing FROM g WHERE k - prev > 1 ORDER BY missing DESC, start LIMIT 5""")
def w01(spark, sf):
    k = table(spark, sf, "orders").where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("k"))
    return T.gaps(k, "k").orderBy(F.desc("missing"), "start").limit(5)


@query("s21_s22_manifest_check", "SELECT page_id AS id, sha256(html) AS digest, page_id % 9 <> 0 AS ok FROM pages")
def s21(spark, sf):
    p = table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.sha2(F.col("html").cast("binary"), 256).alias("digest"))
    manifest = p.select("id", F.when(F.col("id") % 9 == 0, F.lit("0")).otherwise(F.col("digest")).alias("expected"))
    return p.join(manifest, "id").select("id", "digest", (F.col("digest") == F.col("expected")).alias("ok"))


@query("s25_capabilities", "SELECT f AS capability, count(DISTINCT l_suppkey) = 3 AS ready FROM (VALUES ('a', 1), ('a', 2), ('a', 3), ('b', 4), ('b', 5), ('b', 900000)) v(f, x) LEFT JOIN lineitem ON l_suppkey = x GROUP BY 1")
def s25(spark, sf):
    need = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4), ("b", 5), ("b", 900000)], "capability string, l_suppkey long")
    have = need.join(table(spark, sf, "lineitem").select("l_suppkey"), "l_suppkey", "left_semi").groupBy("capability").agg(F.count("*").alias("k"))
    return need.groupBy("capability").agg(F.count("*").alias("n")).join(have, "capability", "left").select("capability", (F.coalesce("k", F.lit(0)) == F.col("n")).alias("ready"))


@query("s02_table_swap", "SELECT r_regionkey AS id, concat(r_name, '!') AS name FROM region")
def s02(spark, sf):
    from corvane.operators.store import swap_in

    path = scratch_dir(spark, "swap")
    r = table(spark, sf, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    swap_in(spark, r, path)
    swap_in(spark, spark.read.parquet(path).withColumn("name", F.concat("name", F.lit("!"))), path)
    return spark.read.parquet(path)


CTES["cues"] = (
    (),
    """SELECT page_id AS item, k, CAST(k * 2.5 AS DOUBLE) AS start, CAST((k + 1) * 2.5 AS DOUBLE) AS stop, (k % 5) * 160 AS x, k // 5 * 90 AS y FROM pages, (SELECT unnest(range(0, 12)) AS k)""",
)


@query("s19_sprite_cues", with_ctes("cues", tail="SELECT item, k AS cue, start, stop, CAST(x AS INT) AS x, CAST(y AS INT) AS y, 160 AS w, 90 AS h FROM cues"))
def s19(spark, sf):
    return T.parse_cues(_vtt(spark, sf)).select("item", "cue", "start", "stop", "x", "y", "w", "h")


def _vtt(spark, sf):
    """WebVTT lines of 12 cues for each page, in the forms that occur: hours, minutes, or bare seconds."""
    clock = lambda s: f"case page_id % 3 when 0 then format_string('%02d:%02d:%06.3f', int(0), int(floor({s} / 60)), {s} % 60) when 1 then format_string('%02d:%06.3f', int(floor({s} / 60)), {s} % 60) else format_string('%.3f', {s}) end"
    p = table(spark, sf, "pages").select("page_id", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("k")).withColumn("a", F.expr("k * 2.5D")).withColumn("b", F.expr("(k + 1) * 2.5D"))
    head = p.selectExpr("page_id as item", "k * 3 as line", f"concat({clock('a')}, ' --> ', {clock('b')}) as text")
    frame = p.selectExpr("page_id", "k * 3 + 1", "concat('sheet.jpg#xywh=', (k % 5) * 160, ',', k div 5 * 90, ',160,90')")
    return head.union(frame).union(p.selectExpr("page_id", "k * 3 + 2", "''"))


@query("s20_sprite_sample", with_ctes("cues", tail="SELECT item, k AS cue, (start + stop) / 2 AS at FROM cues WHERE k % 2 = 0 AND k // 2 < 5"))
def s20(spark, sf):
    return T.sample_cues(T.parse_cues(_vtt(spark, sf)), 5).select("item", "cue", "at")
