"""Relations that the queries derive from the base tables; the SQL twin of each stands beside it.

``CTES`` holds DuckDB text by name, with the names it needs, so that an oracle can pull in what it uses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.runtime import spread, table

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def with_ctes(*names: str, tail: str = "") -> str:
    """WITH clause of the named relations and all that they need, in order."""
    done: list[str] = []

    def add(n: str) -> None:
        for m in CTES[n][0]:
            add(m)
        if n not in done:
            done.append(n)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in done) + ("\n" + tail if tail else "")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """(id, a, b, label): both halves of an embedding as doubles."""
    e = table(spark, sf, "embeddings")
    half = lambda lo: F.transform(F.slice("embedding", lo, 32), lambda x: x.cast("double"))
    return e.select(F.col("vec_id").alias("id"), half(1).alias("a"), half(33).alias("b"), "label")


CTES["vectors"] = ((), "SELECT vec_id AS id, CAST(embedding[1:32] AS DOUBLE[]) AS a, CAST(embedding[33:64] AS DOUBLE[]) AS b, label FROM embeddings")


def mapping(spark: SparkSession, sf: str) -> DataFrame:
    """(cand_id, entity) with gaps."""
    e = table(spark, sf, "embeddings").where("vec_id % 37 <> 0")
    return e.select(F.col("vec_id").alias("cand_id"), F.concat(F.lit("catalog.example:"), F.expr("vec_id % 50")).alias("entity"))


CTES["mapping"] = ((), "SELECT vec_id AS cand_id, concat('catalog.example:', vec_id % 50) AS entity FROM embeddings WHERE vec_id % 37 <> 0")


def _near(side: str, scale: str) -> str:
    return f"""SELECT query_id, cand_id, distance, rank FROM (
  SELECT q.id AS query_id, i.id AS cand_id, d * {scale} AS distance, row_number() OVER (PARTITION BY q.id ORDER BY d * {scale}, i.id) AS rank
  FROM (SELECT * FROM vectors WHERE id % 5 = 0) q JOIN (SELECT * FROM vectors WHERE id % 5 <> 0) i ON true,
  LATERAL (SELECT 1 - list_inner_product(q.{side}, i.{side}) / (sqrt(list_inner_product(q.{side}, q.{side})) * sqrt(list_inner_product(i.{side}, i.{side}))) AS d)
) WHERE rank <= 100"""


CTES["near_a"] = (("vectors",), _near("a", "1.0"))
CTES["near_b"] = (("vectors",), _near("b", "(CASE WHEN q.id % 10 = 0 THEN 0.1 ELSE 1.0 END)"))
CTES["stats_a"] = (("near_a",), "SELECT query_id, min(distance) AS min_d, var_pop(distance) AS var_d, max(distance) - min(distance) AS range_d FROM near_a WHERE rank <= 20 GROUP BY query_id")
CTES["stats_b"] = (("near_b",), "SELECT query_id, min(distance) AS min_d, var_pop(distance) AS var_d, max(distance) - min(distance) AS range_d FROM near_b WHERE rank <= 20 GROUP BY query_id")


def _health(s: str) -> str:
    return f"""CASE WHEN {s}.min_d IS NULL THEN 'no_results' WHEN {s}.min_d >= 0.20 THEN 'healthy'
  WHEN {s}.min_d < 0.10 AND ({s}.var_d < 0.002 OR {s}.range_d < 0.05) THEN 'degenerate'
  WHEN {s}.range_d < 0.03 AND {s}.var_d < 0.001 THEN 'degenerate' ELSE 'healthy' END"""


CTES["plans"] = (
    ("stats_a", "stats_b"),
    f"""SELECT query_id, health_a, health_b, CASE WHEN health_a = 'healthy' AND health_b = 'healthy' THEN 'weighted' WHEN health_a = 'healthy' THEN 'a_only'
  WHEN health_b = 'healthy' THEN 'b_only' ELSE 'a_fallback' END AS plan
FROM (SELECT query_id, {_health("stats_a")} AS health_a, {_health("stats_b")} AS health_b FROM stats_a FULL JOIN stats_b USING (query_id))""",
)
CTES["fused"] = (
    ("near_a", "near_b", "plans", "mapping"),
    """SELECT query_id, cand_id, entity, plan, da, db, CASE WHEN da IS NOT NULL AND db IS NOT NULL THEN da * wa + db * wb
  WHEN plan = 'weighted' THEN coalesce(da, 0.5) * wa + coalesce(db, 0.5) * wb ELSE coalesce(da, db) END AS distance
FROM (SELECT query_id, cand_id, a.distance AS da, b.distance AS db FROM near_a a
      FULL JOIN (SELECT near_b.* FROM near_b JOIN plans USING (query_id) WHERE plan IN ('weighted', 'b_only')) b USING (query_id, cand_id))
JOIN (SELECT query_id, plan, CASE plan WHEN 'weighted' THEN 0.5 WHEN 'b_only' THEN 0.0 ELSE 1.0 END AS wa,
  CASE plan WHEN 'weighted' THEN 0.5 WHEN 'b_only' THEN 1.0 ELSE 0.0 END AS wb FROM plans) USING (query_id) JOIN mapping USING (cand_id)""",
)
CTES["matches"] = (
    ("fused",),
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, cand_id) AS rank FROM fused WHERE distance <= 0.8) WHERE rank <= 10""",
)
CTES["faces"] = (("matches",), "SELECT query_id AS face_id, query_id // 25 AS item_id, query_id % 12 AS frame, entity, distance, rank FROM matches")
CTES["items"] = (
    (),
    """SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS group_id, strftime(o_orderdate, '%Y-%m-%d') AS date, o_totalprice AS duration,
  (o_orderpriority, concat(o_custkey, '-', year(o_orderdate))) AS ext FROM orders""",
)
CTES["item_entities"] = ((), "SELECT DISTINCT l_orderkey AS id, l_suppkey AS entity FROM lineitem")


def items(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("group_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.col("o_totalprice").alias("duration"), F.col("o_orderpriority").alias("endpoint"), F.concat("o_custkey", F.lit("-"), F.year("o_orderdate")).alias("ext_id"),
    )


def item_entities(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return spread(li.select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("entity")), li.count(), "id").distinct()
