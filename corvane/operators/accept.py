"""Accepting upstream changes: a table of field policies compiled to column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators import diff as D


@dataclass(frozen=True)
class Field:
    """What an accepted ``name`` does to the column ``target``: text is taken as it is; whole is taken as a whole number if it is one; start and end are laid over
    a span of years, band, cup, waist and hip over measurements, and there a null leaves what is."""

    name: str
    target: str
    kind: str = "text"


PERSON = (
    Field("name", "name"), Field("note", "note"), Field("height", "height_cm", "whole"), Field("shape", "shape_kind"), Field("start_year", "career", "start"), Field("end_year", "career", "end"),
    Field("band_size", "sizes", "band"), Field("cup_size", "sizes", "cup"), Field("waist_size", "sizes", "waist"), Field("hip_size", "sizes", "hip"),
)


def _text(n: Column) -> Column:
    """A number as text; none and zero are empty."""
    return F.when(F.coalesce(n, F.lit(0)) != 0, n.cast("string")).otherwise("")


def _span(now: Column, given: dict[str, Column]) -> Column:
    old = D.parse_span(now)
    start, end = (F.coalesce(given.get(k, F.lit(None)), _text(old[f"{k}_year"])) for k in ("start", "end"))
    whole = F.when(start != "", F.concat(start, F.lit("-"), end)).when(end != "", F.concat(F.lit("-"), end)).otherwise(now)
    return F.when(F.coalesce(*given.values()).isNull(), now).otherwise(whole)


def _sizes(now: Column, given: dict[str, Column]) -> Column:
    old = D.parse_measurements(now)
    old = {k: F.coalesce(v, F.lit("")) if k == "cup" else _text(v) for k, v in old.items()}
    new = {k: F.coalesce(given[k], v) if k in given else v for k, v in old.items()}
    joined = F.regexp_replace(F.concat(new["band"], new["cup"], F.lit("-"), new["waist"], F.lit("-"), new["hip"]), "-+$", "")
    return F.when(F.coalesce(*given.values()).isNull(), now).otherwise(F.nullif(joined, F.lit("")))


_OVERLAYS = {"start": _span, "end": _span, **dict.fromkeys(("band", "cup", "waist", "hip"), _sizes)}


def compiled(policy: tuple[Field, ...], fields: Column) -> dict[str, Column]:
    """An expression for each target, over its present column and the map ``fields`` of accepted texts."""
    out: dict[str, Column] = {}
    parts: dict[str, dict[str, Column]] = {}
    for f in policy:
        value, now = fields[f.name], F.col(f.target)
        if f.kind in _OVERLAYS:
            parts.setdefault(f.target, {})[f.kind] = value
            out[f.target] = _OVERLAYS[f.kind](now, parts[f.target])
        else:
            number = F.when(F.trim(value).rlike("^[+-]?[0-9]{1,18}$"), F.trim(value).cast("long").cast("string"))
            taken = F.coalesce(number, value) if f.kind == "whole" else value
            out[f.target] = F.when(F.map_contains_key(fields, F.lit(f.name)), taken).otherwise(now)
    return out


def accept(current: DataFrame, changes: DataFrame, policy: tuple[Field, ...] = PERSON) -> DataFrame:
    """``current`` (id, aliases and the policy's targets, texts all) after ``changes`` (id, fields map<string, string>, aliases, more_aliases), one an id at most.

    Given ``aliases`` replace those there are, and ``more_aliases`` are added to those there are (then aliases don't count), without repeats in any case of letters.
    New aliases lose blanks, the entity's name and every name in ``current``; rows without either keep theirs.
    """
    c = changes.select("id", "fields", F.col("aliases").alias("_given"), F.col("more_aliases").alias("_more"))
    rows = current.join(c, "id", "left").withColumn("fields", F.coalesce("fields", F.create_map().cast("map<string,string>")))
    rows = rows.select("id", "aliases", "_given", "_more", *(e.alias(t) for t, e in compiled(policy, F.col("fields")).items()))
    added = F.size(F.coalesce("_more", F.array())) > 0
    now = F.coalesce("aliases", F.array().cast("array<string>"))
    new = F.when(added, F.concat(now, "_more")).otherwise(F.col("_given"))
    others = current.select(F.lit(None).cast("long").alias("id"), "name").where("name is not null").distinct()
    clean = unique_aliases(rows.where(new.isNotNull()).select("id", "name", new.alias("aliases")), others)
    rows = rows.join(clean.withColumnRenamed("aliases", "_clean"), "id", "left").withColumn("aliases", F.coalesce("_clean", "aliases"))
    return rows.drop("_clean", "_given", "_more")


def unique_aliases(rows: DataFrame, names: DataFrame) -> DataFrame:
    """(id, aliases) of ``rows`` (id, name, aliases) in order, without blanks, the own name, repeats, and ``names`` (name), in any case of letters."""
    key = lambda c: F.lower(F.trim(c))
    each = rows.select("id", "name", F.posexplode("aliases").alias("at", "alias")).where("trim(alias) <> ''").select("id", "name", "at", F.trim("alias").alias("alias"))
    each = each.where(~key(F.col("alias")).eqNullSafe(key(F.col("name")))).groupBy("id", F.lower("alias").alias("key")).agg(F.min(F.struct("at", "alias")).alias("x"))
    free = each.join(names.select(F.lower("name").alias("key")).distinct(), "key", "left_anti")
    kept = free.groupBy("id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["alias"]).alias("aliases"))
    return rows.select("id").join(kept, "id", "left").select("id", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))


def batch_choices(changes: DataFrame, skipped: tuple[str, ...] = ("scene",)) -> DataFrame:
    """What to accept of findings' ``changes`` (id, type, field, kind, local, upstream, local_list, upstream_list) when all are accepted at once: id, fields, aliases,
    more_aliases, accepted (a number). Types in ``skipped`` are left to a person.

    Lists (kind list) become the union of both sides; of other fields the upstream value is taken unless it is empty, and nothing if it is the local one. A name
    (kind name) that is replaced becomes an alias. Findings of which nothing would change are left out.
    """
    rows = changes.where(~F.coalesce(F.col("type").isin(*skipped), F.lit(False)))
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    some = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    is_list = F.col("kind") == "list"
    union = F.when(is_list, F.array_union(some("local_list"), some("upstream_list")))
    takes = ~is_list & ~empty(F.col("upstream")) & (F.coalesce("local", F.lit("")) != F.col("upstream"))
    replaced = takes & (F.col("kind") == "name") & ~empty(F.col("local"))
    grown = is_list & (F.size(union) > F.size(some("local_list")))
    out = rows.groupBy("id").agg(
        F.map_from_entries(F.collect_list(F.when(takes, F.struct("field", "upstream")))).alias("fields"),
        F.any_value(union, F.lit(True)).alias("aliases"),
        F.collect_list(F.when(replaced, F.col("local"))).alias("more_aliases"),
        F.count_if(takes | grown).alias("accepted"),
    )
    return out.where("accepted > 0")
