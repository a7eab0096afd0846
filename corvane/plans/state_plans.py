"""Queries for stored state: ordered lifecycles, copy-on-write merges, and streams that resume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.operators import lifecycle as L
from corvane.operators import release as R
from corvane.operators import store as S
from corvane.operators.merge import FILLED, OLD, Stored
from corvane.runtime import scratch_dir, table
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


#: What an event of ``events`` does to the finding of its type and user, by k modulo their number.
KINDS = ["resolve", "dismiss", "update", "reopen", "undismiss", "update", "reopen"]
_K = "CAST(json_extract_string(props, '$.k') AS INT)"
CTES["acts"] = (
    (),
    f"""SELECT concat(event_type, '-', user_id) AS id, event_type AS type, ts AS tm, event_id AS seq, {KINDS}[{_K} % 7 + 1] AS kind, concat('t', {_K}) AS text, {_K} % 4 = 0 AS permanent,
  event_id % 2000 = 0 AS bulk FROM events""",
)
CTES["finding_events"] = (
    ("acts",),
    """SELECT *, row_number() OVER (PARTITION BY id ORDER BY tm, seq, kind, text, permanent) AS nth FROM (
  SELECT id, type, tm, seq, kind, text, permanent FROM acts
  UNION ALL SELECT f.id, f.type, b.tm, b.seq, 'dismiss_pending', b.text, b.permanent FROM (SELECT DISTINCT id, type FROM acts) f JOIN acts b ON b.bulk AND b.type = f.type)""",
)
_FINDINGS_SQL = with_ctes("finding_events").replace("WITH ", "WITH RECURSIVE ", 1) + """,
st AS (SELECT id, type, 0 AS nth, 'pending' AS status, 'first' AS details, CAST(NULL AS VARCHAR) AS action, CAST(NULL AS TIMESTAMP) AS resolved, min(tm) AS updated,
  CAST(NULL AS VARCHAR) AS dismissal, CAST(NULL AS VARCHAR) AS reason FROM acts GROUP BY id, type
  UNION ALL
  SELECT s.id, s.type, e.nth,
    CASE WHEN kind = 'resolve' THEN 'resolved' WHEN kind = 'dismiss' OR kind = 'dismiss_pending' AND status = 'pending' THEN 'dismissed' WHEN kind = 'reopen' AND status = 'dismissed' THEN 'pending' ELSE status END,
    CASE WHEN kind = 'update' AND status = 'pending' OR kind = 'reopen' AND status = 'dismissed' THEN text ELSE details END,
    CASE WHEN kind = 'resolve' THEN text WHEN kind = 'reopen' AND status = 'dismissed' THEN NULL ELSE action END,
    CASE WHEN kind = 'resolve' THEN tm WHEN kind = 'reopen' AND status = 'dismissed' THEN NULL ELSE resolved END,
    CASE WHEN kind IN ('resolve', 'dismiss') OR kind IN ('dismiss_pending', 'update') AND status = 'pending' OR kind = 'reopen' AND status = 'dismissed' THEN tm ELSE updated END,
    CASE WHEN dismissal IS NULL AND (kind = 'dismiss' OR kind = 'dismiss_pending' AND status = 'pending') THEN CASE WHEN permanent THEN 'permanent' ELSE 'soft' END
      WHEN kind = 'undismiss' AND dismissal = 'soft' THEN NULL ELSE dismissal END,
    CASE WHEN dismissal IS NULL AND (kind = 'dismiss' OR kind = 'dismiss_pending' AND status = 'pending') THEN text WHEN kind = 'undismiss' AND dismissal = 'soft' THEN NULL ELSE reason END
  FROM st s JOIN finding_events e ON e.id = s.id AND e.nth = s.nth + 1)
SELECT id, type, status, details, action, resolved, updated, dismissal, reason FROM st QUALIFY row_number() OVER (PARTITION BY id ORDER BY nth DESC) = 1"""


def acts(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), k % len(KINDS) + 1)
    return table(spark, sf, "events").select(
        F.concat_ws("-", "event_type", "user_id").alias("id"), F.col("event_type").alias("type"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), kind.alias("kind"),
        F.concat(F.lit("t"), k).alias("text"), (k % 4 == 0).alias("permanent"), (F.col("event_id") % 2000 == 0).alias("bulk"),
    )


@query("m02_m03_m04_ordered_lifecycle", _FINDINGS_SQL)
def m02(spark, sf):
    a = acts(spark, sf)
    rows = a.groupBy("id", "type").agg(F.min("at").alias("at")).select("id", "type", F.lit("pending").alias("status"), F.lit("first").alias("details"), "at")
    return L.findings(rows, a.select("id", "at", "seq", "kind", "text", "permanent"), a.where("bulk").select("type", "at", "seq", "text", "permanent"))


_STEPS = ["complete", "fail", "total", "progress", "progress", "progress", "progress"]
CTES["run_events"] = (
    (),
    f"""SELECT l_orderkey AS id, o_orderdate + to_hours(l_linenumber) AS tm, CAST(l_linenumber AS BIGINT) AS seq, {_STEPS}[l_partkey % 7 + 1] AS kind, CAST(l_quantity AS BIGINT) AS n,
  CAST(l_linenumber AS BIGINT) AS made, concat('c', l_partkey) AS text FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
)
CTES["restarts"] = ((), "SELECT DISTINCT o_orderdate + to_minutes(150) AS tm FROM orders WHERE o_orderkey % 500 = 0")
CTES["all_run_events"] = (
    ("run_events", "restarts"),
    """SELECT *, row_number() OVER (PARTITION BY id ORDER BY tm, seq, kind, n, made, text) AS nth FROM (SELECT * FROM run_events
  UNION ALL SELECT o_orderkey, (SELECT min(tm) FROM restarts WHERE tm >= o_orderdate), 4611686018427387904, 'restart', NULL, NULL, NULL FROM orders WHERE o_orderdate <= (SELECT max(tm) FROM restarts))""",
)
_RUNS_SQL = with_ctes("all_run_events").replace("WITH ", "WITH RECURSIVE ", 1) + f""",
st AS (SELECT o_orderkey AS id, o_orderpriority AS type, 0 AS nth, 'running' AS status, o_orderdate AS started, CAST(NULL AS TIMESTAMP) AS completed, o_custkey % 100 AS total, CAST(0 AS BIGINT) AS processed,
  CAST(0 AS BIGINT) AS created, CAST(NULL AS VARCHAR) AS cursor, CAST(NULL AS VARCHAR) AS error FROM orders
  UNION ALL
  SELECT s.id, s.type, e.nth, CASE WHEN kind = 'complete' THEN 'completed' WHEN kind = 'fail' OR kind = 'restart' AND status = 'running' THEN 'failed' ELSE status END, started,
    CASE WHEN kind IN ('complete', 'fail') OR kind = 'restart' AND status = 'running' THEN tm ELSE completed END, CASE WHEN kind = 'total' THEN n ELSE total END,
    CASE WHEN kind = 'progress' THEN n ELSE processed END, CASE WHEN kind IN ('progress', 'complete') THEN made ELSE created END, CASE WHEN kind = 'progress' THEN text ELSE cursor END,
    CASE WHEN kind = 'fail' THEN text WHEN kind = 'restart' AND status = 'running' THEN '{L.STALE}' ELSE error END
  FROM st s JOIN all_run_events e ON e.id = s.id AND e.nth = s.nth + 1)
SELECT id, type, status, started, completed, total, processed, created, cursor, error FROM st QUALIFY row_number() OVER (PARTITION BY id ORDER BY nth DESC) = 1"""


@query("m05_run_lifecycle", _RUNS_SQL)
def m05(spark, sf):
    o = table(spark, sf, "orders")
    rows = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("type"), F.col("o_orderdate").alias("at"), (F.col("o_custkey") % 100).alias("total"))
    li = table(spark, sf, "lineitem").join(o, F.col("o_orderkey") == F.col("l_orderkey"))
    kind = F.element_at(F.array(*map(F.lit, _STEPS)), (F.col("l_partkey") % 7 + 1).cast("int"))
    line = F.col("l_linenumber").cast("long")
    events = li.select(
        F.col("l_orderkey").alias("id"), F.expr("timestampadd(HOUR, l_linenumber, o_orderdate)").alias("at"), line.alias("seq"), kind.alias("kind"), F.col("l_quantity").cast("long").alias("n"),
        line.alias("made"), F.concat(F.lit("c"), "l_partkey").alias("text"),
    )
    return L.runs(rows, events, o.where("o_orderkey % 500 = 0").select(F.expr("timestampadd(MINUTE, 150, o_orderdate)").alias("at")))


#: Orders arrive in three batches by their status; within a batch the newest of a key counts.
BATCHES = ["F", "O", "P"]
CTES["snapshots"] = (
    (),
    """SELECT o_orderpriority AS endpoint, o_custkey AS ext_id, o_orderkey AS local_id, o_totalprice AS data, o_orderdate AS updated, instr('FOP', o_orderstatus) AS batch,
  row_number() OVER (PARTITION BY o_orderpriority, o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) AS back FROM orders""",
)


@query("m08_snapshot_merges", with_ctes("snapshots", tail="""SELECT endpoint, ext_id, arg_max(local_id, batch) AS local_id, arg_max(data, batch) AS data, arg_max(updated, batch) AS updated, arg_min(local_id, batch) AS first_id
FROM snapshots WHERE back = 1 AND (endpoint <> '5-LOW' OR batch = 3) GROUP BY endpoint, ext_id"""))
def m08(spark, sf):
    """Snapshots replaced by key, their first owner kept; before the last batch all of one endpoint are deleted."""
    rows = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("endpoint"), F.col("o_custkey").alias("ext_id"), F.col("o_orderkey").alias("local_id"), F.col("o_totalprice").alias("data"), F.col("o_orderdate").alias("updated"),
        F.col("o_orderkey").alias("first_id"), "o_orderstatus",
    )
    stored = Stored(spark, scratch_dir(spark, "snapshots"), ("endpoint", "ext_id"), buckets=16)
    for at, batch in enumerate(BATCHES):
        if at == len(BATCHES) - 1:
            stored.merge(stored.read().where("endpoint = '5-LOW'").select("endpoint", "ext_id"), delete=F.lit(True))
        stored.merge(rows.where(F.col("o_orderstatus") == batch).drop("o_orderstatus"), {"first_id": OLD}, [F.desc("updated"), F.desc("local_id")])
    return stored.read()


CTES["image_prints"] = (
    (),
    """SELECT o_custkey AS image, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 50 AS VARCHAR) END AS gallery, o_orderkey % 9 AS faces, concat('v', instr('FOP', o_orderstatus)) AS version, instr('FOP', o_orderstatus) AS batch,
  row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) AS back FROM orders""",
)


@query("m10_m11_print_merges", with_ctes("image_prints", tail="""SELECT image, arg_max(gallery, batch) AS gallery, arg_max(faces, batch) AS faces, CASE WHEN max(version) = 'v3' THEN 'complete' ELSE 'refresh' END AS status,
  CASE WHEN max(version) = 'v3' THEN 'v3' END AS version FROM image_prints WHERE back = 1 GROUP BY image"""))
def m10(spark, sf):
    """Prints of images: a gallery stays where the new one is null; those of an older version are marked for refresh at the end."""
    gallery = F.when(F.col("o_orderkey") % 3 == 0, (F.col("o_orderkey") % 50).cast("string"))
    rows = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("image"), gallery.alias("gallery"), (F.col("o_orderkey") % 9).alias("faces"), F.lit("complete").alias("status"),
        F.concat(F.lit("v"), F.instr(F.lit("FOP"), F.col("o_orderstatus"))).alias("version"), "o_orderdate", "o_orderkey", "o_orderstatus",
    )
    stored, own = Stored(spark, scratch_dir(spark, "prints"), ("image",), buckets=16), ["image", "gallery", "faces", "status", "version"]
    for at, batch in enumerate(BATCHES):
        some = rows.where(F.col("o_orderstatus") == batch)
        order = [F.desc("o_orderdate"), F.desc("o_orderkey")]
        if at == 0:  # the first merge gives the table its columns
            some = some.groupBy("image").agg(F.max_by(F.struct(*own[1:]), F.struct("o_orderdate", "o_orderkey")).alias("s")).select("image", "s.*")
            order = None
        stored.merge(some, {"gallery": FILLED}, order)
    old = stored.read().where("version <> 'v3'").select("image", F.lit("refresh").alias("status"), F.lit(None).cast("string").alias("version"))
    stored.merge(old, insert=False)
    return stored.read()


CTES["face_prints"] = (
    (),
    """SELECT l_orderkey AS image, l_suppkey AS entity, l_quantity AS confidence, l_linenumber AS line, CASE WHEN l_returnflag = 'N' THEN 2 ELSE 1 END AS batch,
  row_number() OVER (PARTITION BY l_orderkey, l_suppkey, l_returnflag = 'N' ORDER BY l_linenumber DESC, l_quantity DESC) AS back FROM lineitem""",
)


@query("m10_m11_face_merges", with_ctes("face_prints", tail="""SELECT image, entity, arg_max(confidence, batch) AS confidence, arg_max(line, batch) AS line FROM face_prints WHERE back = 1 AND (image % 10 <> 0 OR batch = 2) GROUP BY image, entity"""))
def m11(spark, sf):
    """Faces of images by image and entity: the faces of some images are deleted before the second batch comes."""
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_suppkey").alias("entity"), F.col("l_quantity").alias("confidence"), F.col("l_linenumber").alias("line"), "l_returnflag")
    stored = Stored(spark, scratch_dir(spark, "faces"), ("image", "entity"), buckets=16)
    stored.merge(li.where("l_returnflag <> 'N'").drop("l_returnflag"), order=[F.desc("line"), F.desc("confidence")])
    stored.merge(stored.read().where("image % 10 = 0").select("image", "entity"), delete=F.lit(True))
    stored.merge(li.where("l_returnflag = 'N'").drop("l_returnflag"), order=[F.desc("line"), F.desc("confidence")])
    return stored.read()


@query("s21_s22_release_update", """SELECT 'refused' AS stage, name, n FROM (SELECT 'customer' AS name, count(*) FILTER (WHERE c_custkey % 2 = 0) AS n FROM customer UNION ALL SELECT 'region', count(*) FROM region)
UNION ALL SELECT 'updated', name, n FROM (SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'region', count(*) FROM region)""")
def s21(spark, sf):
    """Row counts of the tables in place, after a release with a changed file was refused, and after the same release, whole, was taken."""
    data, new = scratch_dir(spark, "data"), scratch_dir(spark, "release")
    tables = {name: table(spark, sf, name) for name in ("customer", "supplier", "region")}
    tables["customer"].where("c_custkey % 2 = 0").write.parquet(f"{data}/customer")
    tables["region"].write.parquet(f"{data}/region")
    for name in ("customer", "supplier"):
        tables[name].write.parquet(f"{new}/{name}")
    R.publish(spark, new, "2")
    at = R.Files(spark, new)
    manifest = at.read(R.MANIFEST)
    at.write(R.MANIFEST, manifest | {"checksums": dict.fromkeys(manifest["checksums"], "sha256:" + "0" * 64)})
    counts = lambda stage, names: [spark.read.parquet(f"{data}/{n}").agg(F.count("*").alias("n")).select(F.lit(stage).alias("stage"), F.lit(n).alias("name"), "n") for n in names]
    try:
        R.update(spark, new, data, ["customer", "supplier"])
    except ValueError:
        refused = [x.collect()[0] for x in counts("refused", ["customer", "region"])]
    at.write(R.MANIFEST, manifest)
    R.update(spark, new, data, ["customer", "supplier"])
    out = spark.createDataFrame(refused, "stage string, name string, n long")
    for x in counts("updated", ["customer", "supplier", "region"]):
        out = out.union(x)
    return out


@query("s06_s24_column_scans", """SELECT 'person' AS kind, c_custkey AS id, c_name AS name, count(o_orderkey) AS items FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL
UNION ALL SELECT 'tag', p_partkey, p_name, 0 FROM part UNION ALL SELECT 'group', s_suppkey, s_name, 0 FROM supplier""")
def s06(spark, sf):
    """All entities of three kinds by the columns that a sync needs, people with their number of items; other columns are not read."""
    items = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("o_orderkey").alias("items"))
    people = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")).join(items, "id", "left")
    out = people.select(F.lit("person").alias("kind"), "id", "name", F.coalesce("items", F.lit(0).cast("long")).alias("items"))
    none = F.lit(0).cast("long")
    out = out.union(table(spark, sf, "part").select(F.lit("tag"), "p_partkey", "p_name", none))
    return out.union(table(spark, sf, "supplier").select(F.lit("group"), "s_suppkey", "s_name", none))


@query("b14_cleared_and_rerun", """SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'dismissed' WHEN o_orderkey % 2 = 0 THEN 'pending' ELSE 'resolved' END AS status,
  CASE WHEN o_orderstatus <> 'F' AND o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS run FROM orders WHERE o_orderstatus = 'F' OR o_orderkey % 2 = 1 OR o_orderkey % 3 = 0""")
def b14(spark, sf):
    """A finder's table before and after a rerun: what is pending goes, then what was found anew comes in where nothing is left for its key."""
    status = F.expr("case when o_orderstatus = 'F' then 'dismissed' when o_orderkey % 2 = 0 then 'pending' else 'resolved' end")
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status"), F.lit(1).alias("run"))
    stored = Stored(spark, scratch_dir(spark, "findings"), ("id",), buckets=16)
    stored.merge(rows)
    stored.merge(stored.read().where("status = 'pending'").select("id"), delete=F.lit(True))
    found = table(spark, sf, "orders").where("o_orderkey % 3 = 0 and (o_orderstatus = 'F' or o_orderkey % 2 = 0)").select(F.col("o_orderkey").alias("id"), F.lit("pending").alias("status"), F.lit(2).alias("run"))
    stored.merge(found, {"status": OLD, "run": OLD})
    return stored.read()


@query("d24_link_if_absent", """SELECT s_suppkey AS entity, place, CASE WHEN place = 'a' AND s_nationkey < 10 THEN concat('old', s_suppkey) ELSE concat('new', s_suppkey) END AS ext_id, NOT (place = 'a' AND s_nationkey < 10) AS added
FROM supplier, (VALUES ('a'), ('b')) v(place) WHERE place = 'a' AND s_nationkey < 10 OR s_name ILIKE '%1%'""")
def d24(spark, sf):
    """External ids of entities after links were asked for those that a search by name finds: one is added where the entity has none at that place."""
    s = table(spark, sf, "supplier")
    ids = s.where("s_nationkey < 10").select(F.col("s_suppkey").alias("entity"), F.lit("a").alias("place"), F.concat(F.lit("old"), "s_suppkey").alias("ext_id"))
    hits = s.where(F.col("s_name").ilike("%1%")).select(F.col("s_suppkey").alias("entity"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("place"), F.concat(F.lit("new"), "s_suppkey").alias("ext_id"))
    return S.insert_if_absent(ids.withColumn("added", F.lit(False)), hits.withColumn("added", F.lit(True)), ["entity", "place"], F.col("ext_id"))


@query("w05_stable_order", "SELECT s_nationkey AS nation, s_suppkey AS id, row_number() OVER (PARTITION BY s_nationkey ORDER BY round(s_acctbal / 1000) DESC, length(s_name), s_suppkey) AS place FROM supplier")
def w05(spark, sf):
    """Places within a group by a rounded number downwards, then a length, then the id, so that ties have one order."""
    s = table(spark, sf, "supplier")
    w = Window.partitionBy("s_nationkey").orderBy(F.desc(F.round(F.col("s_acctbal") / 1000)), F.length("s_name"), "s_suppkey")
    return s.select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("id"), F.row_number().over(w).alias("place"))


@query("w06_top_k", "SELECT o_custkey AS owner, o_orderkey AS id, o_totalprice AS price FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def w06(spark, sf):
    """The three best of each owner: a window with a group limit, which drops the others before the shuffle."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    best = table(spark, sf, "orders").withColumn("k", F.row_number().over(w)).where("k <= 3")
    return best.select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
