"""Merging of entities along chains of requests, and repair of entities that nothing names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.runtime import discard, materialise


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(id, component): the least id that each end of ``edges`` (u, v) can reach. Each round takes the least label of all neighbours, then that label's
    own label, so distances halve; labels are combined before each shuffle and written, and it fails rather than stop early."""
    both = edges.where("u <> v").select("u", "v").union(edges.where("u <> v").select("v", "u")).distinct()
    both = materialise(both, "edges")
    labels = materialise(both.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.first("u")).alias("label")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels, F.col("v") == F.col("id")).groupBy("u").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("id") == F.col("u")).select("id", F.col("label").alias("was"), F.least("label", "near").alias("to"))
        far = labels.select(F.col("id").alias("to"), F.col("label").alias("beyond"))
        new = materialise(step.join(far, "to", "left").select("id", "was", F.least("to", "beyond").alias("label")), "labels")
        settled = new.where("was <> label").isEmpty()
        discard(labels)
        labels = new.select("id", "label")
        labels.scratch = new.scratch
        if settled:
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def kept_ids(merges: DataFrame) -> DataFrame:
    """(id, kept) for every end of ``merges`` (source, target), each a request to merge source into target.

    Requests may form chains, meet, or go round. All that is linked becomes one: the least id that is merged into nothing, or, where requests go round and there
    is none, the least id of all.
    """
    known = merges.dropna().where("source <> target").distinct()
    linked = components(known.select(F.col("source").alias("u"), F.col("target").alias("v")))
    last = linked.join(known.select(F.col("source").alias("id")).distinct().withColumn("moves", F.lit(True)), "id", "left")
    kept = last.groupBy("component").agg(F.coalesce(F.min(F.when(F.col("moves").isNull(), F.col("id"))), F.min("id")).alias("kept"))
    return linked.join(kept, "component").select("id", "kept")


def merged(entities: DataFrame, kept: DataFrame) -> DataFrame:
    """``entities`` (id, name, aliases) after merges: a kept one has its own aliases and the names and aliases of those merged into it, without blanks,
    repeats and its own name; sorted. Entities that were merged away are gone; one that a request names and the table lacks leaves its members to the least of them."""
    rows = entities.join(kept, "id", "left").withColumn("kept", F.coalesce("kept", "id"))
    own = F.struct((F.col("id") != F.col("kept")).alias("other"), F.col("id").alias("id"), F.col("name").alias("name"))
    words = F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.array("name"))
    each = rows.select("kept", own.alias("who"), F.explode_outer(words).alias("word"))
    names = each.groupBy("kept").agg(F.min("who").alias("who"), F.collect_set(F.when(F.trim("word") != "", F.col("word"))).alias("words"))
    words = F.array_sort(F.filter("words", lambda w: ~w.eqNullSafe(F.col("who.name"))))
    return names.select(F.col("who.id").alias("id"), F.col("who.name").alias("name"), words.alias("aliases"))


def moved(links: DataFrame, kept: DataFrame, entity: str = "entity") -> DataFrame:
    """``links`` with the kept entity in place of each merged one, and without the repeats that this makes."""
    own = kept.select(F.col("id").alias(entity), "kept")
    return links.join(own, entity, "left").withColumn(entity, F.coalesce("kept", entity)).drop("kept").select(*links.columns).distinct()


def external_id(url: Column, sources: list[tuple[str, str]]) -> Column:
    """The first of ``sources`` (name, pattern with one group, from the text's start) that matches: struct<place, source, ext_id>, or null."""
    out = F.lit(None)
    for place, (name, pattern) in reversed(list(enumerate(sources))):
        found = F.regexp_extract(url, f"^(?:{pattern})", 1)
        out = F.when(found != "", F.struct(F.lit(place).alias("place"), F.lit(name).alias("source"), found.alias("ext_id"))).otherwise(out)
    return out


def repair_plan(members: DataFrame, ids: DataFrame, urls: DataFrame, sources: list[tuple[str, str]]) -> DataFrame:
    """What to do with each entity that has ``members`` (entity) but no external ``ids`` (entity, source, ext_id): entity, n members, source, ext_id, action, into.

    The id comes from its ``urls`` (entity, url), by the order of ``sources`` and then by the url. If the id is someone's, the entity is merged into them; of
    orphans that have one new id the least gets it (insert) and the others are merged into that one. Without an id nothing can be done (none).
    """
    orphans = members.groupBy("entity").agg(F.count("*").alias("n")).join(ids.select("entity"), "entity", "left_anti")
    best = urls.select("entity", external_id(F.col("url"), sources).alias("x"), "url").where("x is not null").groupBy("entity").agg(F.min_by("x", F.struct("x.place", "url")).alias("x"))
    rows = orphans.join(best, "entity", "left").select("entity", "n", "x.source", "x.ext_id")
    owner = ids.groupBy("source", "ext_id").agg(F.min("entity").alias("owner"))
    first = rows.dropna().groupBy("source", "ext_id").agg(F.min("entity").alias("first"))
    rows = rows.join(owner, ["source", "ext_id"], "left").join(first, ["source", "ext_id"], "left")
    into = F.coalesce("owner", "first")
    action = F.when(F.col("ext_id").isNull(), "none").when(F.col("owner").isNull() & (F.col("first") == F.col("entity")), "insert").otherwise("merge")
    return rows.select("entity", "n", "source", "ext_id", action.alias("action"), F.when(F.col("ext_id").isNotNull(), into).alias("into"))


def repaired(entities: DataFrame, members: DataFrame, ids: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities (id, ...) with recomputed ``n_members``, members (entity, ...) and ids (entity, source, ext_id) after ``repair_plan``: members of a merged entity move, the
    entity goes, and an inserted one gets its id."""
    gone = plan.where("action = 'merge'").select("entity", "into")
    members = members.join(gone, "entity", "left").withColumn("entity", F.coalesce("into", "entity")).drop("into").select(*members.columns)
    ids = ids.select("entity", "source", "ext_id").union(plan.where("action = 'insert'").select("entity", "source", "ext_id"))
    counts = members.groupBy(F.col("entity").alias("id")).agg(F.count("*").alias("n_members"))
    entities = entities.join(gone.select(F.col("entity").alias("id")), "id", "left_anti").drop("n_members").join(counts, "id", "left")
    return entities.withColumn("n_members", F.coalesce("n_members", F.lit(0).cast("long"))), members, ids
