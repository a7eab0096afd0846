"""Corpus pipeline: quality, near duplicates, decontamination, mixing, sharding.

Every stage keeps all columns, whatever their names, and passes null ids, null and empty texts and repeated rows on to its
operator, which says what becomes of them; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import decontaminate, mixture, neartext, quality, shards, simhash
from corvane.runtime import scratch_dir, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.3 or more."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id, or the only text without one."""
    return simhash.keep_one(docs, neartext.near_duplicates(docs))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents kept by their rate, at most 1, such that the shares of tokens meet the targets."""
    return mixture.mixed(docs, mixture.labelled_good(table(spark, sf_dir, "labels")), mixture.GOOD_TARGETS)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and slot, read back from the rewritten files; clashing columns as ``shards.resharded_files`` says."""
    return shards.resharded_files(spark, docs).drop("moved")


STAGES = [
    ("quality", quality_stage),
    ("near duplicates", dedup_stage),
    ("decontamination", decontaminate_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: No stage but decontamination can be expressed in SQL, so the rows of run() can't.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents`` in order, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = scratch_dir(spark, f"stage-{name.replace(' ', '-')}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
