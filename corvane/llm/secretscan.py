"""Secret scans weighed by ownership across the corpus.

Candidates of all kinds are found in whole texts; a value's digest is then counted over the whole corpus by
distinct repositories and owners. What many owners hold is a widely copied example; what
one owner alone holds, and looks random, is reported as live, in however many of that owner's repositories it stands.
Candidates of the broad kind (long mixed tokens) become spans only if they are live.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import hot
from corvane.runtime import materialise, ship, table

KINDS = ("assign", "access", "hex", "token")
BASE = 3
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_HINT = re.compile(r"[:=]")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}")
#: A live value has so many bits a character, beside being held by one owner.
LEAST_ENTROPY = 3.5
_CANDIDATES = "array<struct<kind:int,start:int,end:int,digest:binary,random:boolean>>"


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def candidates(text: str | None) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value) by start, then kind; offsets in code points, end exclusive."""
    text = text or ""
    found = []
    if _HINT.search(text):
        found += [(0, m.start(), m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(1, m.start(), m.end(), m[0]) for m in _ACCESS.finditer(text)]
    found += [(2, m.start(), m.end(), m[0]) for m in _HEX.finditer(text)]
    base = [(s, e) for _, s, e, _ in found]
    for m in _TOKEN.finditer(text):
        v = m[0]
        if re.search("[0-9]", v) and re.search("[a-z]", v) and re.search("[A-Z]", v) and not any(s < m.end() and m.start() < e for s, e in base):
            found.append((3, m.start(), m.end(), v))
    return sorted(found, key=lambda c: (c[1], c[0]))


def scan(docs: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """(row, doc_id, text_hash, repo, owner, found) for each row, with a number of its own; found lists its candidates. Null and empty texts have none."""
    ship(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("digest", pa.binary()), ("random", pa.bool_())]))

    def run(batches):
        at = TaskContext.get().partitionId() << 33
        for b in batches:
            out = [
                [{"kind": k, "start": s, "end": e, "digest": hashlib.sha256(v.encode()).digest(), "random": entropy(v) >= LEAST_ENTROPY} for k, s, e, v in candidates(t)]
                for t in b.column(4).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([pa.array(range(at, at + len(out)), pa.int64()), *b.columns[:4], pa.array(out, kind)], names=["row", "doc_id", "text_hash", "repo", "owner", "found"])
            at += len(out)

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), repository.cast("string").alias("repo"), owner.cast("string").alias("owner"), F.col("text"))
    return picked.mapInArrow(run, f"row long, doc_id long, text_hash long, repo string, owner string, found {_CANDIDATES}")


def ownership(scanned: DataFrame) -> DataFrame:
    """(digest, repositories, owners, uses) over the whole corpus.

    Distinct (digest, repository) and (digest, owner) pairs are formed first, so that a value that
    a third of all rows hold is combined before any shuffle by digest. Null repositories and owners count as one more of each.
    """
    each = scanned.select("repo", "owner", F.explode("found").alias("c")).select("repo", "owner", F.col("c.digest").alias("digest"))
    pairs = each.groupBy("digest", "repo", "owner").agg(F.count("*").alias("uses"))
    repos = pairs.groupBy("digest", "repo").agg(F.sum("uses").alias("uses")).groupBy("digest").agg(F.count("*").alias("repositories"), F.sum("uses").alias("uses"))
    owners = pairs.select("digest", "owner").distinct().groupBy("digest").agg(F.count("*").alias("owners"))
    return repos.join(owners, "digest")


def find(docs: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """For each row: doc_id, text_hash (xxhash64 of the text) and its spans, each with kind, start, end, digest, repositories, owners, live.

    Null and empty texts have none. Null repositories or owners count as one more of each; null ids and repeated rows are
    kept, each with its spans, and texts under one id are told apart.
    """
    rows = materialise(scan(docs, repository, owner), "candidates")
    stats = materialise(ownership(rows), "ownership")
    each = rows.select("row", F.explode("found").alias("c")).select("row", "c.*")
    total = stats.agg(F.coalesce(F.sum("uses"), F.lit(0))).first()[0]
    known = hot.join(each, stats, "digest", "uses", total).withColumn("live", F.col("random") & (F.col("owners") == 1))
    spans = known.where((F.col("kind") < BASE) | F.col("live")).groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "end", "digest", "repositories", "owners", "live"))).alias("spans")
    )
    empty = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,digest:binary,repositories:bigint,owners:bigint,live:boolean>>)")
    return rows.select("row", "doc_id", "text_hash").join(spans, "row", "left").select("doc_id", "text_hash", F.coalesce("spans", empty).alias("spans"))


def redact(docs: DataFrame, found: DataFrame, live_only: bool = False) -> DataFrame:
    """``docs`` with the found spans of each text replaced by asterisks; texts without spans stay as they are.

    A row is known by its id, which may be null, and its text; repeated rows are redacted alike, and all columns come along, whatever their names.
    """
    some = found.dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text_hash", F.filter("spans", lambda s: s["live"] | F.lit(not live_only)).alias("spans")).where(F.size("spans") > 0)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text", F.struct("*").alias("all"))
    out = rows.join(some, rows["doc_id"].eqNullSafe(some["doc_id"]) & (rows["text_hash"] == some["text_hash"]), "left")
    hidden = F.aggregate("spans", F.col("text"), lambda t, s: F.overlay(t, F.repeat(F.lit("*"), s["end"] - s["start"]), s["start"] + 1, s["end"] - s["start"]))
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(hidden).alias("text")
    return out.select(*(text if c == "text" else F.col("all")[c].alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of ``documents``, null and empty texts without spans. Each document stands for a repository of its own, and its source for the owner."""
    docs = table(spark, sf_dir, "documents")
    out = find(docs, F.col("doc_id"), F.col("source"))
    names = F.array(*map(F.lit, KINDS))
    told = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] < BASE)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return out.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(told(base), 256).alias("base_sha256"), told("spans").alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda s: s["owners"] > 1)).cast("long").alias("n_copied"),
    )
