"""Stored tables that are merged copy-on-write: only the buckets that a batch of changes touches are read and written again.

A table is a folder of Parquet files by bucket (a hash of its keys) and of versions. A version is one small file that names the folder of each
bucket; it is created last and never changed, so a reader sees a whole version, and a merge that fails before leaves the former one. Two writers that
make the same version can't both succeed.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corvane.runtime import materialise

#: What becomes of a column where a key is known: the new value, the old one, or the new one unless it is null.
NEW, OLD, FILLED = "new", "old", "filled"


@dataclass(frozen=True)
class Stored:
    """A table at ``path`` with one row for each value of ``keys``, none of which is null."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    buckets: int = 64

    def _files(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def version(self) -> int:
        """The number of the last version; 0 if there is none."""
        fs, at = self._files()
        return max((int(s.getPath().getName()) for s in fs.listStatus(at)), default=0) if fs.exists(at) else 0

    def manifest(self, version: int) -> dict:
        at = f"{self.path}/versions/{version:08d}"
        return json.loads(self.spark.read.text(at, wholetext=True).first()[0]) if version else {"schema": None, "buckets": {}}

    def _commit(self, version: int, manifest: dict) -> None:
        fs, at = self._files()
        fs.mkdirs(at)
        out = fs.create(self.spark._jvm.org.apache.hadoop.fs.Path(at, f"{version:08d}"), False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _at(self, manifest: dict, some: set[int] | None = None) -> DataFrame | None:
        paths = [p for k, p in manifest["buckets"].items() if some is None or int(k) in some]
        schema = StructType.fromJson(manifest["schema"]) if manifest["schema"] else None
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema) if schema else None

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last if none is named."""
        rows = self._at(self.manifest(self.version() if version is None else version))
        if rows is None:
            raise ValueError(f"{self.path} has no version yet")
        return rows

    def merge(self, changes: DataFrame, rules: dict[str, str | Column] | None = None, order: list[Column] | None = None, delete: Column | None = None, insert: bool = True) -> int:
        """Merge ``changes`` (keys and any columns) and return the new version's number.

        Of changes with one key the last by ``order`` counts. Where the key is known, ``rules`` tell what becomes of a column: NEW (the default for those that changes
        have; others keep their value), OLD, FILLED, or an expression over old and new columns (``o.`` and ``n.``). Unknown keys are inserted if ``insert``, with nulls where
        changes lack a column. ``delete``, over a change's columns, drops its key instead. The first merge gives the table its columns.
        """
        rules, last = rules or {}, self.version()
        manifest = self.manifest(last)
        change = changes.dropna(subset=list(self.keys))
        if order:
            newest = Window.partitionBy(*self.keys).orderBy(*order)
            change = change.withColumn("_nth", F.row_number().over(newest)).where("_nth = 1").drop("_nth")
        gone = F.coalesce(delete, F.lit(False)) if delete is not None else F.lit(False)
        change = materialise(change.withColumn("_gone", gone).withColumn("_bucket", self._bucket()), "changes")
        touched = {r[0] for r in change.select("_bucket").distinct().collect()}
        old = self._at(manifest, touched)
        fields = list((old if old is not None else changes).schema)
        if old is None:
            old = self.spark.createDataFrame([], changes.schema)
        o, n = old.withColumn("_known", F.lit(True)).alias("o"), change.withColumn("_fresh", F.lit(True)).alias("n")
        on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in self.keys]
        known, fresh = F.col("o._known").isNotNull(), F.col("n._fresh").isNotNull()

        def value(f) -> Column:
            c = f.name
            if c in self.keys:
                return F.coalesce(f"n.{c}", f"o.{c}")
            before, after = F.col(f"o.{c}"), F.col(f"n.{c}") if c in changes.columns else F.lit(None)
            rule = rules.get(c, NEW if c in changes.columns else OLD)
            both = {NEW: after, OLD: before, FILLED: F.coalesce(after, before)}[rule] if isinstance(rule, str) else rule
            return F.when(known & fresh, both).when(fresh, after).otherwise(before).cast(f.dataType)

        rows = o.join(n, on, "full_outer").where(~fresh | (~F.coalesce("n._gone", F.lit(False)) & (known | F.lit(insert))))
        rows = rows.select(*(value(f).alias(f.name) for f in fields)).withColumn("_bucket", self._bucket())
        to = f"{self.path}/data-{uuid.uuid4().hex}"
        rows.repartition("_bucket").write.partitionBy("_bucket").parquet(to)
        fs, _ = self._files()
        listed = fs.listStatus(self.spark._jvm.org.apache.hadoop.fs.Path(to))
        written = {s.getPath().getName().partition("=")[2]: str(s.getPath()) for s in listed if s.isDirectory()}
        kept = {k: p for k, p in manifest["buckets"].items() if int(k) not in touched}
        schema = manifest["schema"] or json.loads(self.spark.createDataFrame([], changes.schema).select(*(f.name for f in fields)).schema.json())
        self._commit(last + 1, {"schema": schema, "buckets": kept | written})
        return last + 1

    def vacuum(self) -> None:
        """Remove what the last version doesn't need; readers of former versions must be done."""
        last = self.version()
        live = {p.rpartition("/")[0] for p in self.manifest(last)["buckets"].values()}
        fs, versions = self._files()
        for s in fs.listStatus(versions.getParent()):
            if s.getPath().getName().startswith("data-") and str(s.getPath()) not in live:
                fs.delete(s.getPath(), True)
        for s in fs.listStatus(versions):
            if int(s.getPath().getName()) < last:
                fs.delete(s.getPath(), False)
