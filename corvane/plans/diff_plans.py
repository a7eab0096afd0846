"""Queries for differences and change feeds: ``customer`` against perturbed twins of itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators import diff as D
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


#: Field by field: kind, and how local, upstream and snapshot come from customer; the same text serves both engines.
FIELDS = {
    "name": ("text", "c_name", "CASE c_custkey % 7 WHEN 1 THEN upper(c_name) WHEN 2 THEN concat(c_name, ' Jr') ELSE c_name END", "CASE WHEN c_custkey % 3 = 1 THEN c_name ELSE concat(c_name, ' Jr') END"),
    "segment": ("text", "CASE WHEN c_custkey % 13 = 0 THEN '' ELSE c_mktsegment END", "CASE c_custkey % 7 WHEN 3 THEN NULL WHEN 4 THEN lower(c_mktsegment) ELSE c_mktsegment END", "c_mktsegment"),
    "since": (
        "date", "concat(1980 + c_custkey % 30, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN '-05' ELSE '-05-01' END)",
        "CASE WHEN c_custkey % 7 < 4 THEN concat(1980 + c_custkey % 30, '-05-01T00:00:00') ELSE concat(1980 + c_custkey % 31, '') END", "concat(1980 + c_custkey % 30, '-05')",
    ),
    "region": ("exact", "CAST(c_nationkey % 5 AS VARCHAR(9))", "CAST(CASE WHEN c_custkey % 7 = 5 THEN 0 ELSE c_nationkey % 5 END AS VARCHAR(9))", "CAST(c_nationkey % 5 AS VARCHAR(9))"),
    "aliases": (
        "aliases", "{0}concat('A', c_custkey % 5), concat('http://x/', c_custkey % 4, '/'), c_name{1}",
        "{0}concat('a', c_custkey % 5), concat('http://x/', c_custkey % 4), CASE WHEN c_custkey % 7 = 6 THEN 'New' ELSE upper(c_name) END{1}", "{0}concat('a', c_custkey % 5){1}",
    ),
}
KINDS = {f: v[0] for f, v in FIELDS.items()}


def _exprs(ends: tuple[str, str]) -> str:
    return ", ".join(f"{v[n + 1].format(*ends) if f == 'aliases' else v[n + 1]} AS {k}_{f}" for f, v in FIELDS.items() for n, k in enumerate("lus"))


def joined(spark, sf) -> DataFrame:
    text = _exprs(("array(", ")")).replace("VARCHAR(9)", "STRING")
    c = table(spark, sf, "customer")
    out = c.selectExpr("c_custkey AS id", "c_custkey % 11 <> 0 AS has_snapshot", *_split(text))
    for f in FIELDS:
        out = out.withColumn(f"s_{f}", F.when(F.col("has_snapshot"), F.col(f"s_{f}")))
    return out


def _split(text: str) -> list[str]:
    """The select list's items: commas within brackets don't part."""
    out, depth, start = [], 0, 0
    for k, ch in enumerate(text):
        depth += (ch in "([") - (ch in ")]")
        if ch == "," and not depth:
            out.append(text[start:k])
            start = k + 1
    return [*out, text[start:]]


CTES["joined"] = ((), f"SELECT c_custkey AS id, c_custkey % 11 <> 0 AS has_snapshot, {_exprs(('[', ']'))} FROM customer")


def _sql_date(c: str) -> str:
    d = f"regexp_replace(trim({c}), '[T ].*$', '')"
    return f"CASE WHEN regexp_full_match({d}, '\\d{{4}}') THEN concat({d}, '-01-01') WHEN regexp_full_match({d}, '\\d{{4}}-\\d{{2}}') THEN concat({d}, '-01') ELSE {d} END"


def _sql_equal(a: str, b: str, kind: str) -> str:
    if kind == "aliases":
        s = lambda c: f"list_sort(list_distinct(list_transform(list_filter({c}, lambda x: lower(x) <> lower(l_name)), lambda x: regexp_replace(lower(x), '/+$', ''))))"
        return f"({s(a)} = {s(b)})"
    if kind == "date":
        a, b = _sql_date(a), _sql_date(b)
    empty = lambda c: f"coalesce(trim({c}) IN ('', '0'), true)"
    same = f"lower({a}) IS NOT DISTINCT FROM lower({b})" if kind != "exact" else f"{a} IS NOT DISTINCT FROM {b}"
    return f"(({empty(a)} AND {empty(b)}) OR {same})"


def _sql_shown(c: str, kind: str) -> str:
    return f"array_to_string(list_sort(list_filter({c}, lambda x: lower(x) <> lower(l_name))), '|')" if kind == "aliases" else c


CTES["changes"] = (
    ("joined",),
    " UNION ALL ".join(
        f"""SELECT id, '{f}' AS field, '{k}' AS merge_type, {_sql_shown(f'l_{f}', k)} AS local, {_sql_shown(f'u_{f}', k)} AS upstream, CASE WHEN has_snapshot THEN {_sql_shown(f's_{f}', k)} END AS previous
FROM joined WHERE NOT {_sql_equal(f'l_{f}', f'u_{f}', k)} AND NOT (has_snapshot AND {_sql_equal(f'u_{f}', f's_{f}', k)})"""
        for f, k in KINDS.items()
    ),
)


@query("j22_d04_three_way_diff", with_ctes("changes", tail="SELECT id, field, merge_type, local, upstream, previous FROM changes"))
def d04(spark, sf):
    return D.diff_fields(joined(spark, sf), KINDS)


@query("d01_emptiness", "SELECT c_custkey AS id, coalesce(trim(v) IN ('', '0'), true) AS empty FROM (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN '0' ELSE c_name END AS v FROM customer)")
def d01(spark, sf):
    v = F.expr("case c_custkey % 5 when 0 then null when 1 then '  ' when 2 then '0' else c_name end")
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), D.is_empty(v).alias("empty"))


@query("d02_p16_values_equal", with_ctes("joined", tail="SELECT id, " + ", ".join(f"{_sql_equal(f'l_{f}', f'u_{f}', k)} AS same_{f}" for f, k in KINDS.items()) + " FROM joined"))
def d02(spark, sf):
    return joined(spark, sf).select("id", *(D.equal(F.col(f"l_{f}"), F.col(f"u_{f}"), k, F.col("l_name")).alias(f"same_{f}") for f, k in KINDS.items()))


@query("d03_normalised_dates", with_ctes("joined", tail=f"SELECT id, {_sql_date('u_since')} AS since FROM joined"))
def d03(spark, sf):
    return joined(spark, sf).select("id", D.normalise_date(F.col("u_since")).alias("since"))


@query("d05_d26_enabled_fields", with_ctes("changes", tail="SELECT id, field FROM changes WHERE field IN ('name', 'since')"))
def d05(spark, sf):
    config = spark.createDataFrame([("name", True), ("since", True), ("segment", False)], "field string, enabled boolean")
    on = {r["field"]: KINDS[r["field"]] for r in config.where("enabled").collect()} or KINDS
    return D.diff_fields(joined(spark, sf), on).select("id", "field")


@query("d06_d14_d25_normalised_records", "SELECT c_custkey AS id, lower(replace(c_name, '#', '-')) AS slug, CASE c_mktsegment WHEN 'BUILDING' THEN 'Construction' ELSE concat(upper(c_mktsegment[1:1]), lower(c_mktsegment[2:])) END AS kind, concat('https://example.org/', c_nationkey) AS url FROM customer")
def d06(spark, sf):
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "Construction").otherwise(F.initcap("c_mktsegment"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lower(F.replace("c_name", F.lit("#"), F.lit("-"))).alias("slug"), kind.alias("kind"), F.concat(F.lit("https://example.org/"), "c_nationkey").alias("url"))


@query("d07_mark_text", """SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN NULL ELSE concat(p_type, CASE WHEN p_size % 2 = 1 THEN concat(': ', p_name) ELSE '' END, '; ', p_brand, ': x') END AS marks FROM part""")
def d07(spark, sf):
    m = F.expr("if(p_size % 4 = 0, null, array(named_struct('location', p_type, 'description', if(p_size % 2 = 1, p_name, '')), named_struct('location', p_brand, 'description', 'x')))")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), D.format_marks(m).alias("marks"))


_MEASURES = "CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN concat(30 + p_size % 10, 'dd-24-x') WHEN 2 THEN concat(30 + p_size % 10, '-', p_size, '-36') WHEN 3 THEN concat('F-', p_size) WHEN 4 THEN concat(p_size, 'C') ELSE NULL END"


@query("d08_measurements", f"""SELECT id, CASE WHEN regexp_full_match(b, '\\d+[A-Za-z]*') THEN TRY_CAST(regexp_extract(b, '^(\\d+)', 1) AS INT) END AS band, nullif(CASE WHEN regexp_full_match(b, '\\d+[A-Za-z]+') THEN upper(regexp_extract(b, '^\\d+([A-Za-z]+)$', 1)) ELSE '' END, '') AS cup,
  TRY_CAST(p[2] AS INT) AS waist, TRY_CAST(p[3] AS INT) AS hip FROM (SELECT id, p, trim(p[1]) AS b FROM (SELECT p_partkey AS id, string_split({_MEASURES}, '-') AS p FROM part))""")
def d08(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), *(c.alias(k) for k, c in D.parse_measurements(F.expr(_MEASURES)).items()))


_SPAN = "CASE o_orderkey % 5 WHEN 0 THEN concat(year(o_orderdate), '-', year(o_orderdate) + 3) WHEN 1 THEN concat(year(o_orderdate), '-') WHEN 2 THEN concat(year(o_orderdate), '') WHEN 3 THEN '?-2001' ELSE NULL END"


@query("d09_year_span", f"SELECT id, TRY_CAST(p[1] AS INT) AS start_year, TRY_CAST(p[2] AS INT) AS end_year FROM (SELECT o_orderkey AS id, string_split({_SPAN}, '-') AS p FROM orders)")
def d09(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), *(c.alias(k) for k, c in D.parse_span(F.expr(_SPAN)).items()))


@query("d10_relation_change", with_ctes("joined", tail="SELECT id FROM joined WHERE l_region IS DISTINCT FROM u_region AND NOT (has_snapshot AND u_region IS NOT DISTINCT FROM s_region)"))
def d10(spark, sf):
    moved = ~F.col("l_region").eqNullSafe(F.col("u_region")) & ~(F.col("has_snapshot") & F.col("u_region").eqNullSafe(F.col("s_region")))
    return joined(spark, sf).where(moved).select("id")


CTES["sets"] = (
    (),
    """SELECT o_orderkey AS id, list_sort(coalesce(l, [])) AS l, list_sort(coalesce(u, [])) AS u FROM orders LEFT JOIN (SELECT l_orderkey AS id,
  list_distinct(list(l_suppkey) FILTER (WHERE l_returnflag <> 'A')) AS l, list_distinct(list(l_suppkey) FILTER (WHERE l_returnflag <> 'R')) AS u FROM lineitem GROUP BY 1) ON id = o_orderkey""",
)


def sets(spark, sf):
    s = lambda flag, n: F.collect_set(F.when(F.col("l_returnflag") != flag, F.col("l_suppkey"))).alias(n)
    g = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(s("A", "l"), s("R", "u"))
    none = F.expr("cast(array() as array<bigint>)")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")).join(g, "id", "left").select("id", F.coalesce("l", none).alias("l"), F.coalesce("u", none).alias("u"))


@query("d11_d12_u02_set_changes", with_ctes("sets", tail="""SELECT id, array_to_string(list_sort(list_filter(u, lambda x: NOT list_contains(l, x))), ',') AS added, array_to_string(list_sort(list_filter(l, lambda x: NOT list_contains(u, x))), ',') AS removed
FROM sets WHERE list_sort(l) <> list_sort(u)"""))
def d11(spark, sf):
    added, removed = D.set_changes(F.col("l"), F.col("u"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return sets(spark, sf).select("id", text(added).alias("added"), text(removed).alias("removed")).where("added <> '' or removed <> ''")


@query("d13_any_change", with_ctes("changes", tail="SELECT id, count(*) AS fields FROM changes GROUP BY id"))
def d13(spark, sf):
    return d04(spark, sf).groupBy("id").agg(F.count("*").alias("fields"))


@query("d15_parent_suppression", "SELECT c_custkey AS id FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE lower(concat('nation_', c_custkey % 25)) <> lower(n_name)")
def d15(spark, sf):
    n = table(spark, sf, "nation")
    j = table(spark, sf, "customer").join(F.broadcast(n), F.col("n_nationkey") == F.col("c_nationkey"))
    return j.where(F.lower(F.concat(F.lit("nation_"), F.col("c_custkey") % 25)) != F.lower("n_name")).select(F.col("c_custkey").alias("id"))


CTES["upstream"] = (
    (),
    """SELECT c_custkey AS id, e AS endpoint, concat('2024-01-', lpad(CAST((c_custkey + length(e)) % 28 + 1 AS VARCHAR), 2, '0')) AS updated, c_custkey % 17 = 0 AS deleted
FROM customer, (VALUES ('one.example'), ('second.example')) v(e) WHERE e = 'one.example' OR c_custkey % 2 = 0""",
)
CTES["findings"] = ((), "SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'dismissed' WHEN 2 THEN 'permanent' WHEN 3 THEN 'resolved' END AS status FROM customer WHERE c_custkey % 5 <> 4")
CTES["fresh"] = (
    ("upstream", "findings"),
    "SELECT * FROM upstream WHERE NOT deleted AND updated > CASE endpoint WHEN 'one.example' THEN '2024-01-05' ELSE '' END AND id NOT IN (SELECT id FROM findings WHERE status = 'permanent')",
)
CTES["first_endpoint"] = (("fresh",), "SELECT id, min(endpoint ORDER BY endpoint DESC) AS e, CASE WHEN bool_or(endpoint = 'second.example') THEN 'second.example' ELSE 'one.example' END AS endpoint FROM fresh GROUP BY id")


def upstream(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.explode(F.expr("if(c_custkey % 2 = 0, array('one.example', 'second.example'), array('one.example'))")).alias("endpoint"))
    return c.select("id", "endpoint", F.expr("concat('2024-01-', lpad(cast((id + length(endpoint)) % 28 + 1 as string), 2, '0')) as updated"), F.expr("id % 17 = 0 as deleted"))


def watermarks(spark):
    return spark.createDataFrame([("one.example", "2024-01-05")], "endpoint string, watermark string")


def findings(spark, sf):
    s = F.expr("case c_custkey % 5 when 0 then 'pending' when 1 then 'dismissed' when 2 then 'permanent' when 3 then 'resolved' end")
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), s.alias("status")).where("status is not null")


def fresh(spark, sf):
    return D.incremental(upstream(spark, sf), watermarks(spark), findings(spark, sf).where("status = 'permanent'"))


@query("d16_t01_p12_incremental", with_ctes("fresh", tail="SELECT id, endpoint, updated FROM fresh"))
def d16(spark, sf):
    return fresh(spark, sf).select("id", "endpoint", "updated")


@query("t02_m07_next_watermark", with_ctes("upstream", tail="SELECT endpoint, greatest(max(updated), CASE endpoint WHEN 'one.example' THEN '2024-01-05' ELSE '' END) AS watermark FROM upstream GROUP BY endpoint"))
def t02(spark, sf):
    return D.next_watermarks(upstream(spark, sf), watermarks(spark))


@query("d17_p13_endpoint_priority", with_ctes("first_endpoint", tail="SELECT id, endpoint FROM first_endpoint"))
def d17(spark, sf):
    order = spark.createDataFrame([("second.example", 0), ("one.example", 1)], "endpoint string, priority int")
    return D.by_priority(fresh(spark, sf), order).select("id", "endpoint")


@query("d18_transition", with_ctes("first_endpoint", "changes", "findings", tail="""SELECT id, CASE WHEN NOT changed AND status = 'pending' THEN 'auto-resolve' WHEN NOT changed THEN 'snapshot' WHEN status = 'pending' THEN 'update'
  WHEN status = 'dismissed' THEN 'reopen' WHEN status IS NULL THEN 'insert' ELSE 'leave' END AS action, NOT changed AS moves_snapshot, changed AND (status IS NULL OR status = 'dismissed') AS created
FROM (SELECT f.id, c.id IS NOT NULL AS changed, status FROM first_endpoint f LEFT JOIN (SELECT DISTINCT id FROM changes) c USING (id) LEFT JOIN findings USING (id))"""))
def d18(spark, sf):
    changed = d04(spark, sf).select("id").distinct().withColumn("changed", F.lit(True))
    worked = d17(spark, sf).select("id").join(changed, "id", "left").select("id", F.coalesce("changed", F.lit(False)).alias("changed"))
    return D.transition(worked, findings(spark, sf))


@query("t03_logic_version", with_ctes("findings", tail="SELECT count(*) AS kept FROM findings WHERE id % 4 = 0"))
def t03(spark, sf):
    snapshots = findings(spark, sf).withColumn("version", F.when(F.col("id") % 4 == 0, 5).otherwise(4))
    return snapshots.where("version = 5").agg(F.count("*").alias("kept"))  # those of an older logic are dropped, and with them the watermark


@query("d19_alias_dedup", """WITH a AS (SELECT c_custkey AS id, c_name AS name, [' x1', 'X1', '', c_name, concat('Customer#', lpad(CAST(c_custkey + 1 AS VARCHAR), 9, '0')), concat('alias ', c_custkey)] AS al FROM customer),
e AS (SELECT id, name, unnest(range(1, 7)) AS pos, trim(unnest(al)) AS alias FROM a)
SELECT a.id, coalesce(list_aliases, '') AS aliases FROM a LEFT JOIN (SELECT id, string_agg(alias, '|' ORDER BY pos) AS list_aliases FROM (
  SELECT *, row_number() OVER (PARTITION BY id, lower(alias) ORDER BY pos) AS k FROM e WHERE alias <> '' AND lower(alias) <> lower(name))
  WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM customer c WHERE lower(c_name) = lower(alias) AND c_custkey <> id) GROUP BY id) USING (id)""")
def d19(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    al = F.array(F.lit(" x1"), F.lit("X1"), F.lit(""), "name", F.concat(F.lit("Customer#"), F.lpad((F.col("id") + 1).cast("string"), 9, "0")), F.concat(F.lit("alias "), "id"))
    return D.dedupe_aliases(c.withColumn("aliases", al), c).select("id", F.array_join("aliases", "|").alias("aliases"))


@query("d20_merge_entities", """SELECT s.l_orderkey AS id, array_to_string(list_sort(list_distinct(list(CASE WHEN l_suppkey % 2 = 1 THEN l_suppkey - 1 ELSE l_suppkey END))), ',') AS entities FROM lineitem s GROUP BY 1""")
def d20(spark, sf):
    merged = F.expr("if(l_suppkey % 2 = 1, l_suppkey - 1, l_suppkey)")  # odd entities are merged into the even one before
    g = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_set(merged)).alias("e"))
    return g.select("id", F.array_join(F.transform("e", lambda x: x.cast("string")), ",").alias("entities"))


@query("d21_d27_accept_update", with_ctes("joined", tail="SELECT id, CASE WHEN coalesce(trim(u_segment), '') = '' THEN l_segment ELSE u_segment END AS segment, CAST(len(list_distinct(list_concat(l_aliases, u_aliases))) AS INT) AS aliases FROM joined"))
def d21(spark, sf):
    u = F.col("u_segment")
    return joined(spark, sf).select("id", F.when(D.is_empty(u), F.col("l_segment")).otherwise(u).alias("segment"), F.size(F.array_union("l_aliases", "u_aliases")).alias("aliases"))


@query("d22_name_conflicts", "SELECT a.p_partkey AS a, min(b.p_partkey) AS b FROM part a JOIN part b ON lower(a.p_name) = lower(b.p_name) AND a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey GROUP BY a.p_partkey")
def d22(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.lower("p_name").alias("n"), "p_brand", "p_type")
    w = Window.partitionBy("n", "p_brand", "p_type").orderBy("p_partkey")
    return p.select(F.col("p_partkey").alias("a"), F.lead("p_partkey").over(w).alias("b")).where("b is not null")


@query("d23_j23_resolve_by_name", """WITH n AS (SELECT lower(p_name) AS key, p_partkey AS id, 0 AS prio, -p_partkey AS o FROM part UNION ALL SELECT lower(concat(p_brand, ' ', p_type)), p_partkey, 1, p_partkey FROM part)
SELECT key, id FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY prio, o) AS k FROM n) WHERE k = 1""")
def d23(spark, sf):
    p = table(spark, sf, "part")
    names = p.select(F.lower("p_name").alias("key"), F.col("p_partkey").alias("id"), F.lit(0).alias("prio"), (-F.col("p_partkey")).alias("o"))
    aliases = p.select(F.lower(F.concat_ws(" ", "p_brand", "p_type")), "p_partkey", F.lit(1), "p_partkey")
    return names.union(aliases).groupBy("key").agg(F.min_by("id", F.struct("prio", "o")).alias("id"))


@query("d24_search_linked", "SELECT s_suppkey AS id, s_name AS name, s_nationkey < 10 AS linked FROM supplier WHERE s_name ILIKE '%00001%'")
def d24(spark, sf):
    return table(spark, sf, "supplier").where(F.col("s_name").ilike("%00001%")).select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), (F.col("s_nationkey") < 10).alias("linked"))


@query("d28_enum_display", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'Brown Eyes' ELSE o_orderpriority END AS shown FROM orders")
def d28(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), D.display_enum(F.expr("if(o_orderkey % 2 = 0, 'BROWN_EYES', o_orderpriority)")).alias("shown"))
