"""Three-way differences between local, upstream and snapshot records, and their normalisers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_empty(c: Column) -> Column:
    """Null, blank text, or zero."""
    t = F.trim(c.cast("string"))
    return c.isNull() | (t == "") | t.rlike("^-?0+(\\.0+)?$")


def is_empty_list(c: Column) -> Column:
    return F.coalesce(F.size(c), F.lit(-1)) <= 0


def normalise_date(c: Column) -> Column:
    """Date text without its time; a year or a month stands for its first day."""
    d = F.regexp_replace(F.trim(c), "[T ].*$", "")
    return F.when(d.rlike("^\\d{4}$"), F.concat(d, F.lit("-01-01"))).when(d.rlike("^\\d{4}-\\d{2}$"), F.concat(d, F.lit("-01"))).otherwise(d)


def alias_set(c: Column, own: Column) -> Column:
    """Lower-cased aliases as a sorted set: own name dropped first, then trailing slashes."""
    kept = F.filter(F.coalesce(c, F.array()), lambda x: F.lower(x) != F.lower(F.coalesce(own, F.lit(""))))
    return F.sort_array(F.array_distinct(F.transform(kept, lambda x: F.regexp_replace(F.lower(x), "/+$", ""))))


def equal(a: Column, b: Column, kind: str, own: Column | None = None) -> Column:
    if kind == "aliases":
        return (is_empty_list(a) & is_empty_list(b)) | (alias_set(a, own) == alias_set(b, own))
    if kind == "date":
        a, b = normalise_date(a), normalise_date(b)
    same = F.lower(a).eqNullSafe(F.lower(b)) if kind in ("text", "date") else a.eqNullSafe(b)
    return (is_empty(a) & is_empty(b)) | same


def shown(c: Column, kind: str, own: Column) -> Column:
    if kind != "aliases":
        return c.cast("string")
    return F.array_join(F.sort_array(F.filter(c, lambda x: F.lower(x) != F.lower(own))), "|")


def diff_fields(joined: DataFrame, fields: dict[str, str], own: str = "l_name") -> DataFrame:
    """``joined`` (id, has_snapshot, and l_, u_, s_ of each field): one row for each field that changed upstream.

    A field is out of step if local and upstream differ; with a snapshot it counts only if upstream has moved since.
    """
    cells = []
    for f, kind in sorted(fields.items()):
        name = F.col(own)
        old = F.when(F.col("has_snapshot"), equal(F.col(f"u_{f}"), F.col(f"s_{f}"), kind, name)).otherwise(False)
        changed = ~equal(F.col(f"l_{f}"), F.col(f"u_{f}"), kind, name) & ~old
        cells.append(F.struct(F.lit(f).alias("field"), F.lit(kind).alias("merge_type"), changed.alias("changed"), *(shown(F.col(f"{k}_{f}"), kind, name).alias(n) for k, n in (("l", "local"), ("u", "upstream"), ("s", "previous")))))
    rows = joined.select("id", F.explode(F.array(*cells)).alias("c")).select("id", "c.*")
    return rows.where("changed").drop("changed")


def set_changes(local: Column, upstream: Column) -> tuple[Column, Column]:
    return F.sort_array(F.array_except(upstream, local)), F.sort_array(F.array_except(local, upstream))


def parse_measurements(c: Column) -> dict[str, Column]:
    """band, cup, waist, hip of text such as 38F-24-35; what does not parse is null."""
    parts = F.split(F.trim(c), "-", 3)
    bust, part = F.trim(F.get(parts, F.lit(0))), lambda k: F.trim(F.get(parts, F.lit(k)))
    ok = bust.rlike("^\\d+[A-Za-z]*$")
    num = lambda x: F.when(x.rlike("^[+-]?\\d+$"), x.try_cast("int"))
    cup = F.upper(F.regexp_extract(bust, "^\\d+([A-Za-z]+)$", 1))
    return {"band": F.when(ok, F.regexp_extract(bust, "^(\\d+)", 1).try_cast("int")), "cup": F.when(ok & (cup != ""), cup), "waist": num(part(1)), "hip": num(part(2))}


def parse_span(c: Column) -> dict[str, Column]:
    """start and end year of text such as 2010-2023, 2010- or 2010."""
    parts = F.split(F.trim(c), "-", 2)
    num = lambda k: F.when(F.trim(F.get(parts, F.lit(k))).rlike("^[+-]?\\d+$"), F.trim(F.get(parts, F.lit(k))).try_cast("int"))
    return {"start_year": num(0), "end_year": num(1)}


def format_marks(c: Column) -> Column:
    """array<struct<location, description>> as "loc: desc; loc"; null stays null."""
    one = F.transform(c, lambda m: F.when(F.coalesce(m["description"], F.lit("")) == "", m["location"]).otherwise(F.concat_ws(": ", m["location"], m["description"])))
    return F.array_join(one, "; ")


def display_enum(c: Column) -> Column:
    """UPPER_CASE constants as words; other text stays."""
    return F.when(c.rlike("^[A-Z][A-Z0-9_]*$"), F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))).otherwise(c)


def dedupe_aliases(aliases: DataFrame, names: DataFrame) -> DataFrame:
    """``aliases`` (id, name, aliases): blanks, the own name, repeats and other entities' names go; order is kept."""
    each = aliases.select("id", "name", F.posexplode("aliases").alias("at", "alias")).withColumn("alias", F.trim("alias"))
    each = each.where("alias <> '' and lower(alias) <> lower(name)").withColumn("key", F.lower("alias"))
    first = each.withColumn("k", F.row_number().over(Window.partitionBy("id", "key").orderBy("at"))).where("k = 1")
    taken = names.select(F.lower("name").alias("key"), F.col("id").alias("other"))
    free = first.join(taken, (first["key"] == taken["key"]) & (first["id"] != taken["other"]), "left_anti")
    kept = free.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "alias"))).alias("kept"))
    return aliases.select("id").join(kept, "id", "left").select("id", F.coalesce(F.transform("kept", lambda x: x["alias"]), F.expr("cast(array() as array<string>)")).alias("aliases"))


def incremental(upstream: DataFrame, watermarks: DataFrame, permanent: DataFrame) -> DataFrame:
    """Rows of ``upstream`` (endpoint, id, updated, deleted) newer than their endpoint's watermark that may be worked on."""
    j = upstream.join(F.broadcast(watermarks), "endpoint", "left").where("watermark is null or updated > watermark")
    return j.where("not deleted").join(permanent, "id", "left_anti")


def next_watermarks(upstream: DataFrame, watermarks: DataFrame) -> DataFrame:
    """The latest of all rows seen, even of those that failed; an endpoint without rows keeps its own."""
    seen = upstream.groupBy("endpoint").agg(F.max("updated").alias("seen"))
    return watermarks.join(seen, "endpoint", "full_outer").select("endpoint", F.greatest("watermark", "seen").alias("watermark"))


def by_priority(rows: DataFrame, priorities: DataFrame) -> DataFrame:
    """Of the endpoints that reach an entity, the first by priority; rows that failed or were deleted don't take part."""
    w = Window.partitionBy("id").orderBy(F.coalesce("priority", F.lit(1 << 30)), "endpoint")
    return rows.join(F.broadcast(priorities), "endpoint", "left").withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def transition(worked: DataFrame, findings: DataFrame) -> DataFrame:
    """``worked`` (id, changed) against ``findings`` (id, status: pending, dismissed, permanent or resolved).

    action, whether the snapshot moves on, and whether the row counts as created.
    """
    j = worked.join(findings, "id", "left")
    s, c = F.col("status"), F.col("changed")
    action = (
        F.when(~c & (s == "pending"), "auto-resolve").when(~c, "snapshot").when(s == "pending", "update").when(s == "dismissed", "reopen")
        .when(s.isNull(), "insert").otherwise("leave")
    )
    return j.select("id", action.alias("action"), (~c).alias("moves_snapshot"), (action.isin("reopen", "insert")).alias("created"))
