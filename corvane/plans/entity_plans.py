"""Queries for merging and repairing entities: ``customer`` holds entities, ``orders`` their members and links, ``pages`` their urls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import accept as A
from corvane.operators import entities as E
from corvane.runtime import materialise, table
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


#: Requests: halves make chains, and the last two of each fifty go round.
_MOVES, _TARGET = "c_custkey % 3 <> 0 OR c_custkey % 50 >= 48", "CASE c_custkey % 50 WHEN 48 THEN c_custkey + 1 WHEN 49 THEN c_custkey - 1 ELSE CAST(floor(c_custkey / 2) AS BIGINT) END"
_NAMED = "c_custkey AS id, concat('C', c_custkey % 40) AS name"
CTES["requests"] = ((), f"SELECT c_custkey AS s, {_TARGET} AS t FROM customer WHERE {_MOVES}")
CTES["links_both"] = (("requests",), "SELECT s AS u, t AS v FROM requests WHERE s <> t UNION SELECT t, s FROM requests WHERE s <> t")
_KEPT = with_ctes("links_both").replace("WITH ", "WITH RECURSIVE ", 1) + """,
reach AS (SELECT u AS id, u AS r FROM links_both UNION SELECT reach.id, v FROM reach JOIN links_both ON u = r),
kept AS (SELECT id, coalesce(min(r) FILTER (WHERE r NOT IN (SELECT s FROM requests WHERE s <> t)), min(r)) AS kept FROM reach GROUP BY id)"""


def kept(spark: SparkSession, sf: str) -> DataFrame:
    return materialise(E.kept_ids(table(spark, sf, "customer").where(_MOVES).selectExpr("c_custkey AS source", f"{_TARGET} AS target")), "kept")


@query("d20_merge_chains", _KEPT + """,
e AS (SELECT c_custkey AS id, concat('C', c_custkey % 40) AS name, [c_mktsegment, concat('N', c_nationkey), ' '] AS aliases FROM customer),
k AS (SELECT e.*, coalesce(kept, e.id) AS kept FROM e LEFT JOIN kept USING (id)),
w AS (SELECT DISTINCT kept, unnest(list_concat(aliases, [name])) AS word FROM k)
SELECT e.id, e.name, coalesce(array_to_string(list_sort(list(word) FILTER (WHERE trim(word) <> '' AND word <> e.name)), '|'), '') AS aliases FROM e JOIN w ON w.kept = e.id GROUP BY e.id, e.name""")
def d20(spark, sf):
    e = table(spark, sf, "customer").selectExpr("c_custkey AS id", "concat('C', c_custkey % 40) AS name", "array(c_mktsegment, concat('N', c_nationkey), ' ') AS aliases")
    return E.merged(e, kept(spark, sf)).select("id", "name", F.array_join("aliases", "|").alias("aliases"))


@query("d20_moved_links", _KEPT + " SELECT DISTINCT o_orderkey % 500 AS item, coalesce(kept, o_custkey) AS entity FROM orders LEFT JOIN kept ON id = o_custkey")
def d20_links(spark, sf):
    return E.moved(table(spark, sf, "orders").selectExpr("o_orderkey % 500 AS item", "o_custkey AS entity"), kept(spark, sf))


#: Where an external id may stand in a url, the first that matches.
SOURCES = [("first", r"https?://[^/]+\.example\.com/([a-z]+/[0-9]+)"), ("second", r"https?://[^/]+\.example\.(?:org|net)/([a-z]+/[0-9]+)")]
CTES["own_urls"] = ((), "SELECT page_id % (SELECT count(*) FROM customer) AS entity, url FROM pages UNION ALL SELECT page_id * 3 % (SELECT count(*) FROM customer), url FROM pages")
CTES["url_ids"] = (
    ("own_urls",),
    "SELECT entity, url, CASE "
    + " ".join(f"WHEN regexp_extract(url, '^(?:{p})', 1) <> '' THEN {{'place': {k}, 'source': '{n}', 'ext_id': regexp_extract(url, '^(?:{p})', 1)}}" for k, (n, p) in enumerate(SOURCES))
    + " END AS x FROM own_urls",
)
CTES["known_ids"] = (("url_ids",), "SELECT DISTINCT entity, x.source AS source, x.ext_id AS ext_id FROM url_ids WHERE x IS NOT NULL AND entity % 2 = 0")
CTES["repair"] = (
    ("url_ids", "known_ids"),
    """SELECT o.entity, n, source, ext_id, CASE WHEN ext_id IS NULL THEN 'none' WHEN owner IS NULL AND first = o.entity THEN 'insert' ELSE 'merge' END AS action, CASE WHEN ext_id IS NOT NULL THEN coalesce(owner, first) END AS into_id
FROM (SELECT *, min(entity) OVER (PARTITION BY source, ext_id) AS first FROM (SELECT o_custkey AS entity, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT entity FROM known_ids) GROUP BY 1)
  LEFT JOIN (SELECT entity, x.source AS source, x.ext_id AS ext_id FROM url_ids WHERE x IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entity ORDER BY x.place, url) = 1) USING (entity)) o
LEFT JOIN (SELECT source, ext_id, min(entity) AS owner FROM known_ids GROUP BY ALL) USING (source, ext_id)""",
)


def repair_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Entities, members, ids and the plan."""
    c, pages = table(spark, sf, "customer"), table(spark, sf, "pages")
    n = c.agg(F.count("*").alias("n")).scalar()
    urls = pages.select((F.col("page_id") % n).alias("entity"), "url").union(pages.select((F.col("page_id") * 3 % n), "url"))
    x = E.external_id(F.col("url"), SOURCES)
    ids = urls.where("entity % 2 = 0").select("entity", x.alias("x")).where("x is not null").select("entity", "x.source", "x.ext_id").distinct()
    members = table(spark, sf, "orders").selectExpr("o_custkey AS entity", "o_orderkey AS member")
    return c.selectExpr("c_custkey AS id", "c_name AS name"), members, ids, materialise(E.repair_plan(members, ids, urls, SOURCES), "repair")


@query("m15_repair_plan", with_ctes("repair", tail="SELECT * FROM repair"))
def m15(spark, sf):
    return repair_inputs(spark, sf)[3].withColumnRenamed("into", "into_id")


@query("m15_repaired_counts", with_ctes("repair", tail="""SELECT c_custkey AS id, c_name AS name, count(e) AS n_members, (SELECT count(*) FROM known_ids k WHERE k.entity = c_custkey) + (SELECT count(*) FROM repair r WHERE r.entity = c_custkey AND action = 'insert') AS n_ids
FROM customer LEFT JOIN (SELECT coalesce(r.into_id, o_custkey) AS e FROM orders LEFT JOIN repair r ON r.entity = o_custkey AND action = 'merge') ON e = c_custkey
WHERE c_custkey NOT IN (SELECT entity FROM repair WHERE action = 'merge') GROUP BY ALL"""))
def m15_counts(spark, sf):
    entities, _, ids = E.repaired(*repair_inputs(spark, sf))
    n = ids.groupBy(F.col("entity").alias("id")).agg(F.count("*").alias("n_ids"))
    return entities.join(n, "id", "left").select("id", "name", "n_members", F.coalesce("n_ids", F.lit(0).cast("long")).alias("n_ids"))


#: The present record of a customer, and the fields that are accepted for it: name, text, and for whom.
_PRESENT = """c_custkey AS id, c_name AS name, c_mktsegment AS note, CAST(140 + c_custkey % 60 AS {0}) AS height_cm, CAST(NULL AS {0}) AS shape_kind,
CASE c_custkey % 5 WHEN 0 THEN '2001-2010' WHEN 1 THEN '2001-' WHEN 2 THEN '2001' WHEN 3 THEN '' END AS career, CASE c_custkey % 4 WHEN 0 THEN '34C-24-36' WHEN 1 THEN '34-24' WHEN 2 THEN '' END AS sizes"""
_ACCEPTED = [("start_year", "'1999'", 2), ("end_year", "'2020'", 3), ("cup_size", "'D'", 5), ("hip_size", "'40'", 7), ("height", "' 0180 '", 11), ("note", "NULL", 13), ("name", "concat(c_name, ' II')", 17)]
_MORE = "CASE WHEN c_custkey % 4 = 1 THEN {0}lower(c_name), 'Xtra', ' xtra ', concat('Customer#', lpad(CAST(c_custkey + 1 AS {2}), 9, '0')){1} END"
_GIVEN = "CASE WHEN c_custkey % 4 = 2 THEN {0}'G', 'g', ' ', concat(c_name, ' ii'){1} END"
CTES["accepting"] = (
    (),
    f"""SELECT *, coalesce(CASE WHEN id % 2 = 0 THEN '1999' END, regexp_extract(career, '^([0-9]+)', 1), '') AS s0, coalesce(CASE WHEN id % 3 = 0 THEN '2020' END, regexp_extract(career, '-([0-9]+)$', 1), '') AS e0,
  coalesce(regexp_extract(sizes, '^([0-9]+)', 1), '') AS band, coalesce(CASE WHEN id % 5 = 0 THEN 'D' END, regexp_extract(sizes, '^[0-9]+([A-Z]+)', 1), '') AS cup,
  coalesce(regexp_extract(sizes, '^[^-]*-([0-9]+)', 1), '') AS waist, coalesce(CASE WHEN id % 7 = 0 THEN '40' END, regexp_extract(sizes, '^[^-]*-[^-]*-([0-9]+)', 1), '') AS hip,
  CASE WHEN id % 17 = 0 THEN concat(name, ' II') ELSE name END AS new_name, CASE WHEN id % 4 = 1 THEN list_concat(old_aliases, more) ELSE given END AS new_aliases
FROM (SELECT {_PRESENT.format("VARCHAR")}, [concat('A', c_custkey % 3), 'a1'] AS old_aliases, {_MORE.format("[", "]", "VARCHAR")} AS more, {_GIVEN.format("[", "]")} AS given FROM customer)""",
)


@query("d21_accepted_fields", with_ctes("accepting", tail="""SELECT id, new_name AS name, CASE WHEN id % 13 = 0 THEN NULL ELSE note END AS note, CASE WHEN id % 11 = 0 THEN '180' ELSE height_cm END AS height_cm, shape_kind,
  CASE WHEN id % 2 <> 0 AND id % 3 <> 0 THEN career WHEN s0 <> '' THEN concat(s0, '-', e0) WHEN e0 <> '' THEN concat('-', e0) ELSE career END AS career,
  CASE WHEN id % 5 <> 0 AND id % 7 <> 0 THEN sizes ELSE nullif(regexp_replace(concat(band, cup, '-', waist, '-', hip), '-+$', ''), '') END AS sizes,
  CASE WHEN new_aliases IS NULL THEN array_to_string(old_aliases, '|') ELSE coalesce((SELECT string_agg(a, '|' ORDER BY i) FROM (SELECT arg_min(trim(a), i) AS a, min(i) AS i FROM (SELECT unnest(new_aliases) AS a, unnest(range(1, len(new_aliases) + 1)) AS i)
    WHERE trim(a) <> '' AND lower(trim(a)) <> lower(new_name) AND lower(trim(a)) NOT IN (SELECT lower(c_name) FROM customer) GROUP BY lower(trim(a)))), '') END AS aliases FROM accepting"""))
def d21(spark, sf):
    c = table(spark, sf, "customer")
    entries = F.array(*(F.struct(F.lit(n).alias("key"), F.expr(f"cast({v} as string)").alias("value"), (F.col("c_custkey") % k == 0).alias("on")) for n, v, k in _ACCEPTED))
    fields = F.map_from_entries(F.transform(F.filter(entries, lambda e: e["on"]), lambda e: F.struct(e["key"], e["value"])))
    now = c.selectExpr(*_items(_PRESENT.format("string")), "array(concat('A', c_custkey % 3), 'a1') AS aliases")
    changes = c.select(F.col("c_custkey").alias("id"), fields.alias("fields"), F.expr(_GIVEN.format("array(", ")")).alias("aliases"), F.expr(_MORE.format("array(", ")", "string")).alias("more_aliases"))
    return A.accept(now, changes).withColumn("aliases", F.array_join("aliases", "|"))


def _items(text: str) -> list[str]:
    """The items of a select list without commas but in brackets."""
    out, depth, start = [], 0, 0
    for k, ch in enumerate(text + ","):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append(text[start:k])
            start = k + 1
    return out


_CHANGES = """SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 5 THEN 'scene' ELSE 'person' END AS type, 'name' AS field, 'name' AS kind, c_name AS local, CASE WHEN c_custkey % 2 = 0 THEN concat(c_name, ' II') ELSE '' END AS upstream,
  CAST(NULL AS {0}) AS local_list, CAST(NULL AS {0}) AS upstream_list FROM customer
UNION ALL SELECT c_custkey, CASE c_custkey % 6 WHEN 5 THEN 'scene' ELSE 'person' END, 'note', 'simple', CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END, c_mktsegment, NULL, NULL FROM customer
UNION ALL SELECT c_custkey, CASE c_custkey % 6 WHEN 5 THEN 'scene' ELSE 'person' END, 'aliases', 'list', NULL, NULL, {1}'a', 'b'{2}, {1}'b', CASE WHEN c_custkey % 4 = 0 THEN 'c' ELSE 'a' END{2} FROM customer"""


@query("d27_batch_choices", f"""SELECT id, coalesce(string_agg(concat(field, '=', upstream), '|' ORDER BY field) FILTER (WHERE takes), '') AS fields, CASE WHEN id % 4 = 0 THEN 'a|b|c' ELSE 'a|b' END AS aliases,
  coalesce(max(local) FILTER (WHERE takes AND kind = 'name'), '') AS more_aliases, count(*) FILTER (WHERE takes OR kind = 'list' AND id % 4 = 0) AS accepted
FROM (SELECT *, kind <> 'list' AND coalesce(upstream, '') <> '' AND coalesce(local, '') <> upstream AS takes FROM ({_CHANGES.format("VARCHAR[]", "[", "]")}) WHERE type <> 'scene') GROUP BY id HAVING accepted > 0""")
def d27(spark, sf):
    table(spark, sf, "customer").createOrReplaceTempView("d27_customer")
    changes = spark.sql(_CHANGES.format("array<string>", "array(", ")").replace("FROM customer", "FROM d27_customer"))
    fields = F.array_sort(F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return A.batch_choices(changes).select("id", F.array_join(fields, "|").alias("fields"), F.array_join("aliases", "|").alias("aliases"), F.array_join("more_aliases", "|").alias("more_aliases"), "accepted")
