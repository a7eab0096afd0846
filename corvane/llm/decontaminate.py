"""Benchmark decontamination with built-in functions only.

The test items' windows of normalised words form a hash set that is broadcast. Every training
text is read once: a bit table over the windows' first two words picks the positions where a
window may start, the words there are joined to the set as whole strings, which verifies the hit,
and what was hit is gathered for each document. Both the bit table and the broadcast are behind
a check of their size; for a larger test set the hashes of all windows, eight bytes each, go through a shuffled join, and
what meets is verified as whole strings where the texts are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.text import ascii_lower
from corvane.runtime import materialise, table

SEPARATORS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
WINDOW = 10
BROADCAST_BYTES = 64 << 20
#: Bits for each window start in the bit table, and the most bits that it may have.
BITS_EACH, MOST_BITS = 16, 1 << 22


def words(text: Column) -> Column:
    """Lower-cased (A-Z only) words; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), f"[{SEPARATORS}]+"), "")


def windows(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """Distinct (item_id, len, win): the item's windows of ``width`` words, or all its words if fewer."""
    w = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0).where("item_id is not null")
    w = w.select("item_id", "w", F.least(F.size("w"), F.lit(width)).alias("len"))
    at = w.select("item_id", "w", "len", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)).alias("i"))
    return at.select("item_id", "len", F.array_join(F.slice("w", F.col("i"), F.col("len")), " ").alias("win")).distinct()


def _bit(h1: str, h2: str | None, bits: int) -> str:
    return f"cast(({h1}{f' ^ shiftrightunsigned({h2}, 7)' if h2 else ''}) & {bits - 1}L as int)"


def _bit_table(starts: DataFrame, column: str, bits: int) -> str:
    cells = [0] * (bits // 64)
    for (k,) in starts.select(column).distinct().collect():  # at most ``bits`` rows
        cells[k >> 6] |= 1 << (k & 63)
    text = ",".join(str(c - (1 << 64) if c >> 63 else c) for c in cells)
    return f"cast(split('{text}', ',') as array<bigint>)"


def hits(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """For each distinct (doc_id, text): n_words, n_hit, items (sorted ids as strings), hit_at (sorted word positions from 0), and the rows that repeat it (times).

    ``docs`` needs doc_id and text, and may have any other columns; null texts have no words; ids may be null; texts under one id are told
    apart by row, xxhash64 of the text. Items without words or id hit nothing.
    """
    wins = materialise(windows(benchmark, width), "windows")
    lengths = sorted(r[0] for r in wins.select("len").distinct().collect())  # at most ``width`` values
    n, size = wins.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("win") + 24), F.lit(0))).first()
    small = size <= BROADCAST_BYTES
    bits = 1 << max(10, (n * BITS_EACH - 1).bit_length())
    base = docs.select(F.col("doc_id"), F.xxhash64("text").alias("row"), words(F.col("text")).alias("w"))
    base = base.select("doc_id", "row", "w", F.size("w").alias("n_words"))
    pos = "filter(sequence(0, n_words - 1), i -> {})"
    picked = small and bits <= MOST_BITS and bool(lengths)
    if picked:
        h = wins.select("len", F.split("win", " ").alias("w")).selectExpr("len", "xxhash64(w[0]) as h1", "xxhash64(coalesce(w[1], '')) as h2")
        test = []
        if lengths[-1] > 1:
            cells = _bit_table(h.where("len > 1").selectExpr(f"{_bit('h1', 'h2', bits)} as k"), "k", bits)
            k = _bit("h[i]", "h[i + 1]", bits)
            test.append(f"(i < n_words - 1 and shiftright({cells}[shiftright({k}, 6)], {k} & 63) & 1 = 1)")
        if lengths[0] == 1:
            cells = _bit_table(h.where("len = 1").selectExpr(f"{_bit('h1', None, bits)} as k"), "k", bits)
            k = _bit("h[i]", None, bits)
            test.append(f"shiftright({cells}[shiftright({k}, 6)], {k} & 63) & 1 = 1")
        base = base.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
        pos = pos.format(" or ".join(test))
    else:
        pos = pos.format("true" if lengths else "false")
    base = base.withColumn("at", F.when(F.col("n_words") > 0, F.expr(pos)).otherwise(F.expr("cast(array() as array<int>)")))
    kind = "string" if picked else "bigint"
    window = "array_join(slice(w, i + 1, {k}), ' ')" if picked else "xxhash64(array_join(slice(w, i + 1, {k}), ' '))"
    cast = f"array(named_struct('pos', -1, 'len', 0, 'win', cast(null as {kind})))"
    each = [f"transform(filter(at, i -> i + {k} <= n_words), i -> named_struct('pos', i, 'len', {k}, 'win', {window.format(k=k)}))" for k in lengths]
    rows = base.select("doc_id", "row", "n_words", F.explode(F.expr(f"concat({', '.join([cast, *each])})")).alias("c")).select("doc_id", "row", "n_words", "c.*")
    if picked:
        known = wins.select("item_id", F.col("win").alias("_win"))
        found = rows.join(F.broadcast(known), F.col("win") == F.col("_win"), "left").where("pos < 0 or item_id is not null")
    else:
        known = wins.select("item_id", F.xxhash64("win").alias("win"), F.col("win").alias("whole"))
        met = rows.where("pos >= 0").join(F.broadcast(known) if small else known, "win").select("doc_id", "row", "pos", "len", "item_id", "whole").distinct()
        texts = base.select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), "w").join(met, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_row") == F.col("row")))
        sure = texts.where("whole = array_join(slice(w, pos + 1, len), ' ')").select("doc_id", "row", F.lit(0).alias("n_words"), "pos", "len", "item_id").distinct()
        found = rows.where("pos < 0").select("doc_id", "row", "n_words", "pos", "len", F.lit(None).cast(wins.schema["item_id"].dataType).alias("item_id")).union(sure)
    out = found.groupBy("doc_id", "row").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.count_if(F.col("pos") < 0).alias("times"),
        F.collect_set(F.when(F.col("pos") >= 0, F.struct("pos", "len"))).alias("spans"),
        F.collect_set(F.col("item_id").cast("string")).alias("items"),
    )
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["pos"], s["pos"] + s["len"] - 1)))))
    out = out.select("doc_id", "row", "times", "n_words", covered.alias("hit_at"), F.sort_array("items").alias("items"))
    return out.withColumn("n_hit", F.size("hit_at").cast("long"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", width: int = WINDOW) -> DataFrame:
    """``docs`` without contaminated documents, or (mode "spans") with the hit words cut out of their texts.

    Clean rows come back as they were, repeated ones and null texts included, with all columns, whatever their names; texts under one id, which may be null, are judged apart.
    """
    bad = materialise(hits(docs, benchmark, width).where("n_hit > 0").select("doc_id", "row", "hit_at"), "hits")
    rows = docs.select("doc_id", F.xxhash64("text").alias("row"), "text", F.struct("*").alias("all"))
    same = rows["doc_id"].eqNullSafe(bad["doc_id"]) & (rows["row"] == bad["row"])
    if mode == "documents":
        return rows.join(bad, same, "left_anti").select("all.*")
    piece = F.regexp_extract_all("text", F.lit(f"([^{SEPARATORS}]+[{SEPARATORS}]*)"), 1)
    kept = F.filter(piece, lambda x, i: ~F.array_contains("hit_at", i))
    cut = F.concat(F.regexp_extract("text", f"^([{SEPARATORS}]*)", 1), F.array_join(kept, ""))
    text = F.when(F.col("hit_at").isNull(), F.col("text")).otherwise(cut).alias("text")
    return rows.join(bad.select(bad["doc_id"], bad["row"], "hit_at"), same, "left").select(*(text if c == "text" else F.col("all")[c].alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of ``documents``, repeated ones included; null texts and items without words hit nothing."""
    out = hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
bi AS (SELECT item_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM bw),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM bi),
di AS (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM di),
hit AS (SELECT doc_id, i, dw.n AS n, item_id FROM dw JOIN win USING (win)),
cov AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit),
nh AS (SELECT doc_id, count(*) AS n_hit FROM cov GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN nh USING (doc_id) LEFT JOIN it USING (doc_id)
"""
