"""Queries for the findings and job store: ``events`` stands for requests and rows, ``orders`` for jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators import store as S
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


CTES["recs"] = (
    (),
    """SELECT event_id AS id, event_type AS type, user_id AS target, CASE event_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'dismissed' ELSE 'resolved' END AS status, ts AS created, CAST(json_extract_string(props, '$.k') AS INT) AS k, value FROM events""",
)


def recs(spark, sf) -> DataFrame:
    s = F.expr("case event_id % 3 when 0 then 'pending' when 1 then 'dismissed' else 'resolved' end")
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("id"), F.col("event_type").alias("type"), F.col("user_id").alias("target"), s.alias("status"), F.col("ts").alias("created"), F.get_json_object("props", "$.k").cast("int").alias("k"), "value")


@query("p01_filtered_page", with_ctes("recs", tail="SELECT id, type, target FROM recs WHERE status = 'pending' ORDER BY created DESC, id LIMIT 40 OFFSET 10"))
def p01(spark, sf):
    return S.page(S.optional(recs(spark, sf), status="pending", type=None), 40, 10, F.desc("created"), F.col("id")).select("id", "type", "target")


@query("p02_filtered_count", with_ctes("recs", tail="SELECT count(*) AS n FROM recs WHERE status = 'pending' AND type = 'click'"))
def p02(spark, sf):
    return S.optional(recs(spark, sf), status="pending", type="click").agg(F.count("*").alias("n"))


@query("p03_point_lookup", with_ctes("recs", tail="SELECT min(id) AS id FROM recs WHERE type = 'view' AND target = 7"))
def p03(spark, sf):
    return S.optional(recs(spark, sf), type="view", target=7).agg(F.min("id").alias("id"))


@query("p07_first_non_null", "SELECT l_orderkey AS id, arg_min(l_partkey, l_linenumber * 100000000 + l_partkey) FILTER (WHERE l_returnflag = 'A') AS first_part FROM lineitem GROUP BY 1")
def p07(spark, sf):
    first = F.min_by(F.when(F.col("l_returnflag") == "A", F.col("l_partkey")), F.when(F.col("l_returnflag") == "A", F.struct("l_linenumber", "l_partkey")))
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(first.alias("first_part"))


@query("p08_p09_needs_work", "SELECT o_orderkey AS id, NOT (o_orderstatus = 'F' AND v IS NOT DISTINCT FROM '2') AS work FROM (SELECT *, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '1' ELSE '2' END AS v FROM orders)")
def p08(spark, sf):
    v = F.expr("case o_orderkey % 4 when 0 then null when 1 then '1' else '2' end")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (~((F.col("o_orderstatus") == "F") & v.eqNullSafe(F.lit("2")))).alias("work"))


@query("p10_due_schedules", "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'P' AND (CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate END IS NULL OR o_orderdate <= TIMESTAMP '1997-01-01')")
def p10(spark, sf):
    due = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate"))
    return table(spark, sf, "orders").where("o_orderstatus <> 'P'").where(due.isNull() | (due <= F.expr("timestamp '1997-01-01'"))).select(F.col("o_orderkey").alias("id"))


@query("p14_payload_predicate", with_ctes("recs", tail="SELECT id FROM recs WHERE k >= 90"))
def p14(spark, sf):
    return table(spark, sf, "events").where(F.try_variant_get(F.parse_json("props"), "$.k", "int") >= 90).select(F.col("event_id").alias("id"))


@query("p15_suffix_keep", "SELECT event_id AS id FROM events WHERE concat(event_type, ':', user_id) NOT LIKE '%:7'")
def p15(spark, sf):
    return table(spark, sf, "events").where(~F.concat_ws(":", "event_type", "user_id").like("%:7")).select(F.col("event_id").alias("id"))


@query("a01_counts_by_type_and_status", with_ctes("recs", tail="SELECT type, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'dismissed') AS dismissed, count(*) FILTER (WHERE status = 'resolved') AS resolved FROM recs GROUP BY type"))
def a01(spark, sf):
    return recs(spark, sf).groupBy("type").pivot("status", ["pending", "dismissed", "resolved"]).count().na.fill(0)


@query("a02_store_stats", with_ctes("recs", tail="SELECT count(*) AS total, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'dismissed') AS dismissed, count(*) FILTER (WHERE CAST(created AS DATE) = DATE '2024-01-05') AS runs_today FROM recs"))
def a02(spark, sf):
    s = F.col("status")
    return recs(spark, sf).agg(F.count("*").alias("total"), F.count_if(s == "pending").alias("pending"), F.count_if(s == "dismissed").alias("dismissed"), F.count_if(F.to_date("created") == F.lit("2024-01-05").cast("date")).alias("runs_today"))


@query("a03_fingerprint_stats", "SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS complete, count(*) FILTER (WHERE o_orderstatus = 'F' AND o_orderkey % 4 > 1) AS current FROM orders")
def a03(spark, sf):
    done = F.col("o_orderstatus") == "F"
    return table(spark, sf, "orders").agg(F.count("*").alias("total"), F.count_if(done).alias("complete"), F.count_if(done & (F.col("o_orderkey") % 4 > 1)).alias("current"))


@query("j14_j15_not_dismissed", with_ctes("recs", tail="SELECT DISTINCT target FROM recs WHERE type = 'click' AND target NOT IN (SELECT target FROM recs WHERE type = 'error' AND status = 'dismissed')"))
def j14(spark, sf):
    r = recs(spark, sf)
    return r.where("type = 'click'").select("target").distinct().join(r.where("type = 'error' and status = 'dismissed'").select("target"), "target", "left_anti")


@query("m01_insert_if_absent", with_ctes("recs", tail="""SELECT type, target, id FROM (SELECT type, target, id, row_number() OVER (PARTITION BY type, target ORDER BY CASE WHEN status = 'resolved' THEN 0 ELSE 1 END, id) AS k FROM recs) WHERE k = 1"""))
def m01(spark, sf):
    r = recs(spark, sf)
    old = S.latest(r.where("status = 'resolved'"), ["type", "target"], F.col("id")).select("type", "target", "id")
    return S.insert_if_absent(old, r.where("status <> 'resolved'").select("type", "target", "id"), ["type", "target"], F.col("id"))


@query("m02_m03_m04_lifecycle", with_ctes("recs", tail="""SELECT id, CASE WHEN status = 'pending' AND k < 20 THEN 'resolved' WHEN status = 'dismissed' AND k < 40 THEN 'pending' WHEN status = 'pending' AND k >= 80 THEN 'dismissed' ELSE status END AS status FROM recs"""))
def m02(spark, sf):
    s, k = F.col("status"), F.col("k")
    after = F.when((s == "pending") & (k < 20), "resolved").when((s == "dismissed") & (k < 40), "pending").when((s == "pending") & (k >= 80), "dismissed").otherwise(s)
    return recs(spark, sf).select("id", after.alias("status"))


@query("m05_w13_latest_runs", with_ctes("recs", tail="SELECT type, target, id, status FROM recs QUALIFY row_number() OVER (PARTITION BY type, target ORDER BY created DESC, id DESC) = 1"))
def m05(spark, sf):
    return S.latest(recs(spark, sf), ["type", "target"], F.desc("created"), F.desc("id")).select("type", "target", "id", "status")


@query("m06_m09_settings_upsert", with_ctes("recs", tail="""SELECT target, coalesce(n.v, o.v) AS v, coalesce(n.w, o.w) AS w FROM (SELECT target, min(k) AS v, max(k) AS w FROM recs WHERE type = 'view' GROUP BY 1) o
FULL JOIN (SELECT target, CASE WHEN min(k) > 5 THEN min(k) END AS v, CAST(NULL AS INT) AS w FROM recs WHERE type = 'error' GROUP BY 1) n USING (target)"""))
def m06(spark, sf):
    r = recs(spark, sf)
    old = r.where("type = 'view'").groupBy("target").agg(F.min("k").alias("v"), F.max("k").alias("w"))
    new = r.where("type = 'error'").groupBy("target").agg(F.min("k").alias("v")).select("target", F.when(F.col("v") > 5, F.col("v")).alias("v"), F.lit(None).cast("int").alias("w"))
    return S.upsert_non_null(old, new, ["target"])


@query("m08_t04_snapshots", with_ctes("recs", tail="SELECT target, type, arg_max(k, id) AS k FROM recs GROUP BY ALL"))
def m08(spark, sf):
    return recs(spark, sf).groupBy("target", "type").agg(F.max_by("k", "id").alias("k"))


@query("m10_m11_fingerprint_upsert", "SELECT l_orderkey AS id, l_suppkey AS entity, arg_max(l_linenumber, l_linenumber) AS line, count(*) AS n FROM lineitem GROUP BY ALL")
def m10(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("entity"), F.col("l_linenumber").alias("line"))
    n = li.groupBy("id", "entity").agg(F.count("*").alias("n"))
    return S.latest(li, ["id", "entity"], F.desc("line")).join(n, ["id", "entity"])


CTES["jobs"] = (
    (),
    """SELECT o_orderkey AS id, ['GPU', 'CPU', 'NETWORK', 'LIGHT'][o_orderkey % 4 + 1] AS resource, CAST(o_orderpriority[1:1] AS INT) AS priority, o_orderdate AS created,
  CASE WHEN o_orderkey % 400 < 4 THEN 'running' WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'queued' END AS status FROM orders""",
)
_SLOTS = "(VALUES ('GPU', 6), ('CPU', 9), ('NETWORK', 40), ('LIGHT', 80)) s(resource, slots)"


def jobs(spark, sf):
    o = table(spark, sf, "orders")
    resource = F.element_at(F.array(*map(F.lit, ("GPU", "CPU", "NETWORK", "LIGHT"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    status = F.expr("case when o_orderkey % 400 < 4 then 'running' when o_orderstatus = 'F' then 'completed' else 'queued' end")
    return o.select(F.col("o_orderkey").alias("id"), resource.alias("resource"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), F.col("o_orderdate").alias("created"), status.alias("status"))


CTES["typed_jobs"] = (
    (),
    """SELECT o_orderkey AS id, o_custkey AS type, ['queued', 'running', 'stopping', 'completed', 'failed', 'cancelled', 'completed', 'completed'][o_orderkey % 8 + 1] AS status,
  CASE WHEN o_orderkey % 8 > 0 THEN o_orderdate END AS started, CASE WHEN o_orderkey % 8 > 2 THEN o_orderdate END AS completed, CASE WHEN o_orderkey % 8 = 4 THEN 'old' END AS error, o_orderkey % 100 AS items_processed, 100 AS items_total FROM orders""",
)
_ACTIONS = "CASE WHEN o_orderkey % 3 = 0 THEN ['start', 'complete', 'fail', 'cancel', 'stop'][o_orderkey // 8 % 5 + 1] END"


def typed_jobs(spark, sf):
    o, n = table(spark, sf, "orders"), F.col("o_orderkey") % 8
    status = F.element_at(F.array(*map(F.lit, ("queued", "running", "stopping", "completed", "failed", "cancelled", "completed", "completed"))), (n + 1).cast("int"))
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("type"), status.alias("status"), F.when(n > 0, F.col("o_orderdate")).alias("started"), F.when(n > 2, F.col("o_orderdate")).alias("completed"),
        F.when(n == 4, "old").alias("error"), (F.col("o_orderkey") % 100).alias("items_processed"), F.lit(100).alias("items_total"),
    )


@query("m12_submit_jobs", with_ctes("typed_jobs", tail="SELECT c_custkey AS type, CASE WHEN EXISTS (SELECT 1 FROM typed_jobs j WHERE j.type = c_custkey AND status IN ('queued', 'running', 'stopping')) THEN 'rejected' ELSE 'queued' END AS answer FROM customer"))
def m12(spark, sf):
    return S.submit(typed_jobs(spark, sf), table(spark, sf, "customer").select(F.col("c_custkey").alias("type"))).select("type", "answer")


@query("m12_transitions", with_ctes("typed_jobs", tail=f"""SELECT id, CASE action WHEN 'start' THEN 'running' WHEN 'complete' THEN 'completed' WHEN 'fail' THEN 'failed' WHEN 'cancel' THEN 'cancelled' WHEN 'stop' THEN 'stopping' ELSE status END AS status,
  CASE WHEN action = 'start' THEN moment ELSE started END AS started, CASE WHEN action IN ('complete', 'fail', 'cancel') THEN moment ELSE completed END AS completed, CASE WHEN action = 'fail' THEN 'new' ELSE error END AS error
FROM typed_jobs JOIN (SELECT o_orderkey AS id, {_ACTIONS} AS action, o_orderdate + INTERVAL 1 DAY AS moment FROM orders) USING (id)"""))
def m12_transitions(spark, sf):
    action = F.element_at(F.array(*map(F.lit, ("start", "complete", "fail", "cancel", "stop"))), (F.pmod(F.floor(F.col("o_orderkey") / 8), F.lit(5)) + 1).cast("int"))
    changes = table(spark, sf, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), action.alias("action"), F.expr("o_orderdate + interval 1 day").alias("at"), F.lit("new").alias("message"))
    return S.transition(typed_jobs(spark, sf), changes)


@query("m12_requeue_and_purge", with_ctes("typed_jobs", tail="""SELECT id, 'queued' AS status, CAST(NULL AS TIMESTAMP) AS started, CASE WHEN status = 'queued' THEN items_processed ELSE 0 END AS items_processed, CASE WHEN status = 'queued' THEN items_total END AS items_total
FROM typed_jobs WHERE status IN ('queued', 'running', 'stopping')"""))
def m12_requeue(spark, sf):
    return S.purge_terminal(S.requeue_interrupted(typed_jobs(spark, sf))).select("id", "status", "started", "items_processed", "items_total")


@query("m13_schedules", "SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN o_orderdate ELSE o_orderdate + to_seconds(CAST(floor((o_orderkey % 7 + 0.5) * 3600) AS BIGINT)) END AS next_run FROM orders")
def m13(spark, sf):
    later = F.expr("timestampadd(SECOND, cast((o_orderkey % 7 + 0.5D) * 3600 as int), o_orderdate)")
    keep = (F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 2 == 0)
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(keep, F.col("o_orderdate")).otherwise(later).alias("next_run"))


@query("w10_queue_order", with_ctes("jobs", tail="SELECT id, row_number() OVER (ORDER BY priority, created, id) AS place FROM jobs WHERE status = 'queued'"))
def w10(spark, sf):
    return S.queue_order(jobs(spark, sf)).select("id", "place")


@query("w11_dispatch", with_ctes("jobs", tail=f"""SELECT id, resource FROM (SELECT *, row_number() OVER (PARTITION BY resource ORDER BY priority, created, id) AS k FROM jobs WHERE status = 'queued')
JOIN {_SLOTS} USING (resource) LEFT JOIN (SELECT resource, count(*) AS used FROM jobs WHERE status = 'running' GROUP BY 1) USING (resource) WHERE k <= slots - coalesce(used, 0)"""))
def w11(spark, sf):
    slots = spark.createDataFrame([("GPU", 6), ("CPU", 9), ("NETWORK", 40), ("LIGHT", 80)], "resource string, slots int")
    return S.dispatch(jobs(spark, sf), slots).select("id", "resource")


@query("w12_must_yield", with_ctes("jobs", tail="SELECT id FROM jobs r WHERE status = 'running' AND EXISTS (SELECT 1 FROM jobs q WHERE q.status = 'queued' AND q.resource = r.resource AND q.priority < r.priority)"))
def w12(spark, sf):
    return S.must_yield(jobs(spark, sf)).select("id")


@query("a23_queue_metrics", with_ctes("jobs", tail="SELECT resource, count(*) FILTER (WHERE status = 'queued') AS queued, count(*) FILTER (WHERE status = 'running') AS running FROM jobs GROUP BY 1"))
def a23(spark, sf):
    return jobs(spark, sf).groupBy("resource").agg(F.count_if(F.col("status") == "queued").alias("queued"), F.count_if(F.col("status") == "running").alias("running"))


@query("m16_settings", "SELECT c_custkey AS id, coalesce(CASE WHEN TRY_CAST(o AS DOUBLE) BETWEEN 1 AND 64 THEN TRY_CAST(o AS DOUBLE) END, CASE WHEN c_nationkey < 12 THEN 16.0::DOUBLE END, 4.0::DOUBLE) AS batch FROM (SELECT *, CASE c_custkey % 4 WHEN 0 THEN 'x' WHEN 1 THEN '100' WHEN 2 THEN '32' END AS o FROM customer)")
def m16(spark, sf):
    o = F.expr("case c_custkey % 4 when 0 then 'x' when 1 then '100' when 2 then '32' end")
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), S.setting(o, F.when(F.col("c_nationkey") < 12, 16), 4, 1, 64).alias("batch"))


@query("m15_orphan_repair", r"""SELECT CASE WHEN known THEN 'merge' ELSE 'insert' END AS action, count(*) AS n FROM (SELECT DISTINCT host, EXISTS (SELECT 1 FROM pages p WHERE p.page_id % 2 = 0 AND regexp_extract(p.url, '^https?://([^/]+)/', 1) = host) AS known
FROM (SELECT regexp_extract(url, '^https?://([^/]+)/', 1) AS host FROM pages WHERE page_id % 2 = 1)) GROUP BY 1""")
def m15(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)/", 1).alias("host"))
    known = p.where("page_id % 2 = 0").select("host").distinct().withColumn("known", F.lit(True))
    return p.where("page_id % 2 = 1").select("host").distinct().join(known, "host", "left").groupBy(F.when(F.col("known"), "merge").otherwise("insert").alias("action")).agg(F.count("*").alias("n"))
