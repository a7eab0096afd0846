"""Prefix trie of conversations, built a family at a time and merged.

Conversations that share a base id are a family. One shuffle by base id brings a family together: its conversations
are rebuilt from the first turns of the base conversation and their own later turns, and combined into the nodes
of the family's small trie. Only these nodes move again, to be merged into the nodes of all families.

A prefix is known by 128 bits: the sum without carry of two hashes of each turn with its place. Sums over a subtree
are sums over the conversations that start with it: each node is counted along the path of its smallest member alone, from the end of the
path to its start, so no step goes through the trie level by level and a long conversation costs as much as its turns.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm import hot
from corvane.runtime import discard, materialise, ship, table

WORD = r"[^\x20\x09-\x0D]+"
#: The query's families, and the number of heads that it takes of a base at most.
FAMILY, HEADS = 20, 4
KEY = ["k1", "k2"]


def turns(conversations: DataFrame, base: Column, head: Column, most: int) -> DataFrame:
    """(base, conv_id, depth, k1, k2, p1, p2, words, last): the path of each rebuilt conversation, from the root (depth 0) on.

    ``head`` (at most ``most``) tells how many first turns a conversation takes from its ``base``. k is the prefix's key and p its
    parent's (null at the root), words are those of its last turn, and last marks a path's end.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select(base.alias("base"), "conv_id", head.alias("head"), "turn", role.alias("role"), text.alias("text")).repartition("base")
    own = Window.partitionBy("base", "conv_id")
    rows = rows.withColumn("at", F.row_number().over(own.orderBy(F.asc_nulls_first("turn"), "role", "text"))).select(
        "base", "conv_id", "head", "at", F.xxhash64("role", "text").alias("h1"), F.xxhash64("text", F.lit(11), "role").alias("h2"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words")
    )
    turn = [F.col(c) for c in ("at", "h1", "h2", "words")]
    first = F.when((F.col("conv_id") == F.col("base")) & (F.col("at") <= most), F.struct(*turn))
    rows = rows.withColumn("heads", F.array_sort(F.collect_list(first).over(Window.partitionBy("base"))))

    taken = F.filter("heads", lambda x: x["at"] <= F.col("head"))
    moved = F.col("at") - F.col("head") + F.size(taken)
    root = F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"), F.lit(0).cast("long").alias("words"))
    none = F.array().cast("array<struct<at:int,h1:bigint,h2:bigint,words:bigint>>")
    start = F.when(F.col("at") == 1, F.concat(F.array(root), taken)).otherwise(none)
    later = F.when(F.col("at") > F.col("head"), F.array(F.struct(moved.alias("at"), *turn[1:]))).otherwise(none)
    path = rows.select("base", "conv_id", F.explode(F.concat(start, later)).alias("x")).select("base", "conv_id", F.col("x.at").alias("depth"), "x.h1", "x.h2", "x.words")

    along = own.orderBy("depth")
    salted = [F.when(F.col("depth") == 0, 0).otherwise(F.xxhash64(*c)) for c in (("depth", "h1", "h2"), ("h2", "depth", "h1"))]
    path = path.select("base", "conv_id", "depth", "words", *(F.bit_xor(s).over(along.rowsBetween(Window.unboundedPreceding, 0)).alias(k) for s, k in zip(salted, KEY)))
    return path.select("*", *(F.lag(k).over(along).alias(p) for k, p in zip(KEY, ("p1", "p2"))), F.lead("depth").over(along).isNull().alias("last"))


def family_nodes(path: DataFrame) -> DataFrame:
    """The nodes of each family's trie: members, the smallest of them, whether one goes on, and who ends here (ascending, comma-joined)."""
    ends = F.sort_array(F.collect_list(F.when(F.col("last"), F.col("conv_id"))))
    return path.groupBy("base", "depth", *KEY).agg(
        F.count("*").alias("n_convs"),
        F.min("conv_id").alias("conv_id"),
        F.first("words").alias("words"),
        F.first("p1").alias("p1"),
        F.first("p2").alias("p2"),
        F.max(~F.col("last")).alias("inner"),
        F.array_join(ends.cast("array<string>"), ",").alias("ends"),
    )


def digests(nodes: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of nodes at which a conversation ends: its families' ends pass by in order, one row at a time."""
    ship(nodes.sparkSession)

    def work(batches):
        last, sha = None, None
        for b in batches:
            out = []
            for k1, k2, ends in zip(*(b.column(c).to_pylist() for c in range(3))):
                if (k1, k2) == last:
                    sha.update(b",")
                else:
                    if last:
                        out.append((*last, sha.hexdigest()))
                    last, sha = (k1, k2), hashlib.sha256()
                sha.update(ends.encode())
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip((*KEY, "ends_sha256"), r)) for r in out], schema)
        if last:
            yield pa.RecordBatch.from_pylist([dict(zip((*KEY, "ends_sha256"), (*last, sha.hexdigest())))], schema)

    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])
    rows = nodes.where("ends <> ''").select(*KEY, "ends", "base").repartition(*KEY).sortWithinPartitions(*KEY, "base").select(*KEY, "ends")
    return rows.mapInArrow(work, "k1 long, k2 long, ends_sha256 string")


def trie(path: DataFrame) -> DataFrame:
    """A row for each node of the trie over the paths that ``turns`` gives, with what its members and its subtree add up to."""
    path = materialise(path, "paths")
    families = materialise(family_nodes(path), "family-nodes")
    merged = families.groupBy(*KEY).agg(
        F.first("depth").alias("depth"),
        F.sum("n_convs").alias("n_convs"),
        F.min("conv_id").alias("conv_id"),
        F.first("p1").alias("p1"),
        F.first("p2").alias("p2"),
        F.max("inner").alias("inner"),
        F.count("*").alias("m"),
    )
    merged = materialise(merged, "nodes")

    shared = merged.where("m > 1").select(*KEY, "m", F.col("n_convs").alias("all_convs"), F.col("conv_id").alias("owner"), F.col("inner").alias("goes_on"))
    owned = hot.join(families, shared, KEY, "m", families.count(), "left").where("owner is null or owner = conv_id")
    saved = ((F.coalesce("all_convs", "n_convs") - 1) * F.col("words")).alias("saved")
    own = owned.select("base", "conv_id", "depth", *(F.lit(None).cast("long").alias(k) for k in KEY), saved, (~F.coalesce("goes_on", "inner")).cast("long").alias("leaf"))
    zero = F.lit(0).cast("long")
    rows = path.select("base", "conv_id", "depth", *KEY, zero.alias("saved"), zero.alias("leaf")).union(own.where("saved > 0 or leaf > 0"))
    onward = Window.partitionBy("base", "conv_id").orderBy(F.desc("depth"))
    sums = rows.repartition("base").select(*KEY, *(F.sum(c).over(onward).alias(c) for c in ("saved", "leaf"))).where("k1 is not null")

    parts = sums.select(*KEY, "saved", "leaf", zero.alias("child")).union(merged.where("depth > 0").select("p1", "p2", zero, zero, F.lit(1).cast("long")))
    totals = materialise(parts.groupBy(*KEY).agg(F.sum("saved").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"), F.sum("child").alias("n_children")), "sums")
    parents = materialise(merged.select(*KEY, F.col("conv_id").alias("parent_conv_id")).join(totals.where("n_children > 0").select(*KEY, "n_children"), KEY).toDF("p1", "p2", "parent_conv_id", "weight"), "parents")
    rows = hot.join(merged.where("depth > 0"), parents, ["p1", "p2"], "weight", merged.count()).unionByName(merged.where("depth = 0"), allowMissingColumns=True)
    out = rows.select(*KEY, "conv_id", "depth", "parent_conv_id", "n_convs").join(totals, KEY).join(digests(families), KEY, "left")
    nothing = F.lit(hashlib.sha256().hexdigest())
    out = out.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
    out = materialise(out, "trie")
    discard(path, families, merged, totals, parents)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of all rebuilt conversations.

    Rows without a conv_id belong to no conversation; null roles and texts are empty; turns are in order of turn (null first), then of
    role and text, and repeated rows are turns of their own. An empty table has no nodes. Other columns are not read.
    """
    c = F.col("conv_id")
    head = F.crc32(c.cast("string").cast("binary")) % HEADS
    return trie(turns(table(spark, sf_dir, "conversations"), c - c % FAMILY, head.cast("int"), HEADS - 1))


_CRC_STEP = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
ORACLE = f"""
with t as (select conv_id c, turn, coalesce(role, '') r, coalesce(text, '') x from conversations where conv_id is not null),
o as (select c, list({{'r': r, 'x': x}} order by turn nulls first, r, x) l from t group by c),
h as (select c, l, c - c % 20 b, xor(4294967295, list_reduce(list_concat([4294967295::bigint],
    list_transform(string_split(c::varchar, ''), lambda s: ascii(s)::bigint)), lambda a, b: {_CRC_STEP})) % 4 h from o),
w as (select h.c, list_concat(coalesce(b.l[1:h.h], []), h.l[h.h + 1:]) l from h left join o b on b.c = h.b),
p as (select c, l, unnest(range(0, len(l) + 1)) d from w),
n as (select d, l[1:d] k, count(*) n, min(c) conv_id, sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (len(l) = d), '')) e,
    coalesce(len(regexp_extract_all(l[d].x, '[^\\x20\\x09-\\x0D]+')), 0) words from p group by d, l[1:d], coalesce(len(regexp_extract_all(l[d].x, '[^\\x20\\x09-\\x0D]+')), 0)),
q as (select a.*, u.conv_id parent, (select count(*) from n b where b.d = a.d + 1 and b.k[1:a.d] = a.k) kids from n a left join n u on u.d = a.d - 1 and a.k[1:u.d] = u.k)
select any_value(v.conv_id) conv_id, v.d depth, any_value(v.parent) parent_conv_id, any_value(v.n) n_convs, any_value(v.kids) n_children,
    count(*) filter (x.kids = 0) n_leaves, sum((x.n - 1) * x.words)::bigint saved_tokens, any_value(v.e) ends_sha256
from q v join q x on x.d >= v.d and x.k[1:v.d] = v.k group by v.d, v.k
"""
