"""Minimum-cost-flow resharding.

From the byte sizes of the old shards and the capacities of the new ones, a minimum-cost flow
says how many bytes go from where to where: a byte that stays costs nothing, one that moves costs
one. The flow is cut into contiguous transfers over each old shard's blocks, and only files of
shards that gain or lose rows need rewriting.

A block is a hash range of ids and sizes within an old shard; there are as many as the shard's rows ask
for, within bounds, so only block totals (a bounded number of rows) reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.runtime import materialise, scratch_dir, table

ROWS_A_BLOCK, LEAST_BLOCKS, MOST_BLOCKS = 20_000, 32, 8_192


def min_cost_flow(supply: list[int], capacity: list[int]) -> list[list[int]]:
    """Bytes from each old shard to each new one; staying at the same number is free.

    Successive shortest paths with Bellman-Ford over the residual graph.
    """
    a, b = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("the new shards can't hold the old ones")
    src, dst = a + b, a + b + 1
    graph: list[list[list[int]]] = [[] for _ in range(a + b + 2)]  # [to, room, cost, index of the reverse edge]

    def edge(u: int, v: int, room: int, cost: int) -> None:
        graph[u].append([v, room, cost, len(graph[v])])
        graph[v].append([u, 0, -cost, len(graph[u]) - 1])

    for i, s in enumerate(supply):
        edge(src, i, s, 0)
        for j in range(b):
            edge(i, a + j, s, int(i != j))
    for j, c in enumerate(capacity):
        edge(a + j, dst, c, 0)
    while True:
        cost: dict[int, int] = {src: 0}
        via: dict[int, tuple[int, int]] = {}
        queue = [src]
        while queue:
            u = queue.pop(0)
            for k, (v, room, c, _) in enumerate(graph[u]):
                if room > 0 and cost[u] + c < cost.get(v, 1 << 60):
                    cost[v], via[v] = cost[u] + c, (u, k)
                    queue.append(v)
        if dst not in via:
            break
        path, v = [], dst
        while v != src:
            u, k = via[v]
            path.append((u, k))
            v = u
        push = min(graph[u][k][1] for u, k in path)
        for u, k in path:
            graph[u][k][1] -= push
            graph[graph[u][k][0]][graph[u][k][3]][1] += push
    flow = [[0] * b for _ in range(a)]
    for i in range(a):
        for v, _, _, back in graph[i]:
            if a <= v < a + b:
                flow[i][v - a] = graph[v][back][1]
    return flow


def text_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def old_shard(docs: DataFrame, old_shards: int) -> Column:
    """The layout before: whole sources lie together, so the shards are far from equal."""
    key = F.col("source").cast("string") if "source" in docs.columns else F.col("doc_id").cast("string")
    return F.pmod(F.xxhash64(key), F.lit(old_shards)).cast("int")


def reshard(rows: DataFrame, size: Column, old: Column, old_shards: int, new_shards: int) -> DataFrame:
    """``rows`` with shard (int, 0 to new_shards - 1), slot (long, gapless from 0 in each shard) and moved (boolean).

    ``rows`` needs doc_id; ``size`` is a row's bytes (null: none) and ``old`` its shard before (null: the first). All columns come
    along, whatever their names (a clashing shard, slot or moved, in any case of letters, is replaced). The new shards' bytes differ by the rows at
    the cuts at most. Null ids are hashed like others, repeated rows are interchangeable, and an
    empty table gives an empty one. Only block totals reach the driver: old_shards * MOST_BLOCKS
    rows at most, and as much is broadcast.
    """
    spark = rows.sparkSession
    columns = [c for c in rows.columns if c.lower() not in ("shard", "slot", "moved")]
    work = rows.select("doc_id", F.coalesce(size.cast("long"), F.lit(0)).alias("size"), F.coalesce(old.cast("int"), F.lit(0)).alias("old"), F.struct(*columns).alias("all"))
    narrow = materialise(work.drop("all"), "sizes")
    total = {r[0]: (int(r[1]), r[2]) for r in narrow.groupBy("old").agg(F.sum("size"), F.count("*")).collect()}
    supply = [total.get(i, (0, 0))[0] for i in range(old_shards)]
    whole = sum(supply)
    flow = min_cost_flow(supply, [whole // new_shards + (j < whole % new_shards) for j in range(new_shards)])
    n_blocks = [min(MOST_BLOCKS, max(LEAST_BLOCKS, -(-total.get(i, (0, 0))[1] // ROWS_A_BLOCK))) for i in range(old_shards)]
    block = F.pmod(F.xxhash64("doc_id", "size"), F.element_at(F.array(*map(F.lit, n_blocks)), F.col("old") + 1)).cast("int")
    sums = narrow.groupBy("old", block.alias("block")).agg(F.sum("size").alias("b")).collect()
    starts, ends = [], {}
    for i, k, b in sorted(map(tuple, sums)):
        starts.append((i, k, ends.get(i, 0)))
        ends[i] = ends.get(i, 0) + b
    begins = F.broadcast(spark.createDataFrame(starts or [(-1, 0, 0)], "old int, block int, begin long"))
    cuts = []
    for i, sent in enumerate(flow):
        done, mine = 0, []
        for j in sorted((j for j in range(new_shards) if sent[j]), key=lambda j: (j != i, j)):  # what stays comes first
            mine.append((done, j))
            done += sent[j]
        cuts.append(mine or [(0, 0)])
    limits = F.array(*(F.array(*(F.struct(F.lit(a).cast("long").alias("at"), F.lit(j).alias("to")) for a, j in c)) for c in cuts))

    def placed(df: DataFrame) -> DataFrame:
        w = Window.partitionBy("old", "block").orderBy("doc_id", "size")
        before = F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
        df = df.withColumn("block", block).withColumn("before", before).withColumn("rank", F.row_number().over(w))
        df = df.join(begins, ["old", "block"]).withColumn("at", F.col("begin") + F.col("before"))
        own = F.element_at(limits, F.col("old") + 1)
        return df.withColumn("to", F.element_at(F.filter(own, lambda c: c["at"] <= F.col("at")), -1)["to"])

    parts = placed(narrow).groupBy("to", "old", "block").agg(F.count("*"), F.min("rank")).collect()
    base, filled = [], {}
    for j, i, k, n, first in sorted(map(tuple, parts)):
        base.append((j, i, k, filled.get(j, 0) - first))
        filled[j] = filled.get(j, 0) + n
    bases = F.broadcast(spark.createDataFrame(base or [(-1, 0, 0, 0)], "to int, old int, block int, base long"))
    out = placed(work).join(bases, ["to", "old", "block"])
    return out.select("all.*", F.col("to").alias("shard"), (F.col("base") + F.col("rank")).alias("slot"), (F.col("to") != F.col("old")).alias("moved"))


def rewrite(resharded: DataFrame, old: Column, folder: str) -> tuple[DataFrame, list[int]]:
    """Write the files of the shards that gain or lose rows to the new ``folder``, partitioned by shard, and say which these are.

    ``resharded`` is what :func:`reshard` returns and ``old`` each row's shard before. Returns the rows of all shards, those of
    rewritten ones read back from their files, and the rewritten shards' numbers. ``folder`` is fresh: nothing is overwritten that is still read, and the old files of rewritten
    or emptied shards can go once this returns. Each row lies once in the new layout; nulls, repeated rows and any extra columns come along; an empty table writes nothing.
    """
    spark = resharded.sparkSession
    held = resharded.withColumn("shard", F.col("shard").cast("int"))
    met = {tuple(r) for r in held.select(old.cast("int"), "shard").distinct().collect()}  # pairs of shard numbers only
    touched = sorted({j for a, b in met if a is not None and a != b for j in (a, b)})
    changed = held.where(F.col("shard").isin(touched))
    changed.write.partitionBy("shard").parquet(folder)
    columns = held.columns
    back = spark.read.schema(held.schema).parquet(folder).select(*columns) if touched else held.limit(0)
    if all(b in touched for _, b in met):
        return back, touched
    return back.union(held.where(~F.col("shard").isin(touched)).select(*columns)), touched


OLD_SHARDS, NEW_SHARDS = 6, 8


def resharded_files(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """All of ``docs``, whole, with shard, slot and moved, read back from the rewritten files.

    A document's own column named shard, slot or moved, in any case of letters, comes back with ``_before`` behind its name.
    """
    taken, aside = {c.lower() for c in docs.columns}, {}
    for c in docs.columns:
        if c.lower() in ("shard", "slot", "moved"):
            aside[c] = f"{c}_before"
            while aside[c].lower() in taken:
                aside[c] += "_"
            taken.add(aside[c].lower())
    docs = docs.withColumnsRenamed(aside)
    placed = reshard(docs, text_size(F.col("text")), old_shard(docs, OLD_SHARDS), OLD_SHARDS, NEW_SHARDS)
    out, _ = rewrite(placed, old_shard(placed, OLD_SHARDS), scratch_dir(spark, "shards"))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of ``documents``; size and checksum are those of the text in the rewritten shards' files. A null text counts one byte, and equal rows are interchangeable."""
    out = resharded_files(spark, table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", text_size(F.col("text")).alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), old_shard(out, OLD_SHARDS).alias("old_shard"), "moved",
    )
