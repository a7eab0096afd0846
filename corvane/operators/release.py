"""Releases of several tables: digests against a manifest, and a swap of all of them that is finished or undone as a whole.

A release is a folder of tables (folders of files) and a manifest that whoever made it has written: a version and the SHA-256 of each file. Files
are read and digested by Spark's tasks. The swap first moves the tables that will be replaced to a backup, then the new ones in, over Hadoop's
file system. A journal is written before the first move and removed after the last; if it is found, the moves are undone from the backup.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST, JOURNAL = "manifest.json", "swap-journal.json"
OK, CHANGED, ABSENT, UNLISTED = "ok", "changed", "absent", "unlisted"


@dataclass(frozen=True)
class Files:
    """A folder on Hadoop's file system."""

    spark: SparkSession
    root: str

    def _path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, name: str = "") -> bool:
        return self._fs().exists(self._path(name))

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs().listStatus(self._path())) if self.exists() else []

    def read(self, name: str) -> dict:
        return json.loads(self.spark.read.text(f"{self.root}/{name}", wholetext=True).first()[0])

    def write(self, name: str, content: dict) -> None:
        out = self._fs().create(self._path(name), True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()

    def make(self) -> None:
        self._fs().mkdirs(self._path())

    def drop(self, name: str = "") -> None:
        self._fs().delete(self._path(name), True)

    def move(self, name: str, to: Files) -> None:
        if not self._fs().rename(self._path(name), to._path(name)):
            raise OSError(f"could not move {name} from {self.root} to {to.root}")


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """(file, bytes, sha256) of the files in the tables of ``folder``; names are relative to it. A file of 2 GB or more can't be read whole, and fails."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{folder}/*/")
    root = spark._jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath()
    name = F.element_at(F.split("path", F.lit(f"{root}/".replace(".", "[.]")), 2), 2)
    found = rows.select(name.alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    return found.where(F.contains("file", F.lit("/")) & ~F.element_at(F.split("file", "/"), -1).rlike("^[._]"))


def publish(spark: SparkSession, folder: str, version: str) -> None:
    """Write the manifest of the tables in ``folder``. There is an entry for each file; their number, not their size, is what the driver holds."""
    sums = {r["file"]: f"sha256:{r['sha256']}" for r in digests(spark, folder).select("file", "sha256").collect()}
    Files(spark, folder).write(MANIFEST, {"version": version, "checksums": sums})


def checked(spark: SparkSession, folder: str) -> DataFrame:
    """(file, state) of all files that the manifest of ``folder`` names or that lie there."""
    sums = Files(spark, folder).read(MANIFEST)["checksums"]
    wanted = spark.createDataFrame([(f, s.rpartition(":")[2]) for f, s in sums.items()] or [(None, None)], "file string, wanted string").dropna()
    both = wanted.join(digests(spark, folder), "file", "full_outer")
    state = F.when(F.col("wanted").isNull(), UNLISTED).when(F.col("sha256").isNull(), ABSENT).when(F.col("sha256") == F.lower("wanted"), OK).otherwise(CHANGED)
    return both.select("file", state.alias("state"))


def verify(spark: SparkSession, folder: str, required: list[str]) -> str:
    """The version of the release in ``folder``, if its manifest and all ``required`` tables are there and every file is as the manifest says."""
    at = Files(spark, folder)
    if not at.exists(MANIFEST):
        raise FileNotFoundError(f"the release lacks {MANIFEST}")
    missing = sorted(t for t in required if not at.exists(t))
    if missing:
        raise FileNotFoundError(f"the release lacks {', '.join(missing)}")
    bad = checked(spark, folder).where(F.col("state") != OK).orderBy("file").limit(5).collect()
    if bad:
        raise ValueError("not as the manifest says: " + ", ".join(f"{r['file']} ({r['state']})" for r in bad))
    return at.read(MANIFEST)["version"]


def swap(spark: SparkSession, release: str, data: str, tables: list[str], on_move: Callable[[str, str], None] | None = None) -> str:
    """Put those of ``tables`` that ``release`` has in the place of the ones in ``data``, and return the folder of what was there before.

    Other tables in ``data`` stay as they are. ``on_move`` is called before each move with its phase and table. If a move fails, ``recover`` undoes the others.
    """
    new, old = Files(spark, release), Files(spark, data)
    mine = [t for t in tables if new.exists(t)]
    backup = Files(spark, f"{data}/backup-{uuid.uuid4().hex}")
    backup.make()
    before = [t for t in mine if old.exists(t)]
    old.write(JOURNAL, {"backup": backup.root, "before": before, "new": mine})
    for phase, source, to, names in (("backup", old, backup, before), ("install", new, old, mine)):
        for t in names:
            if on_move:
                on_move(phase, t)
            source.move(t, to)
    old.drop(JOURNAL)
    return backup.root


def restore(spark: SparkSession, data: str, backup: str, new: list[str], before: list[str]) -> None:
    """Bring back the tables of ``before`` from ``backup``, and drop those of ``new`` that were not there; tables that were never moved stay. It may be run again."""
    at, saved = Files(spark, data), Files(spark, backup)
    for t in new:
        if saved.exists(t):
            at.drop(t)
            saved.move(t, at)
        elif t not in before:
            at.drop(t)
    at.drop(JOURNAL)
    saved.drop()


def recover(spark: SparkSession, data: str) -> bool:
    """Undo a swap that was cut short; whether there was one."""
    at = Files(spark, data)
    if not at.exists(JOURNAL):
        return False
    j = at.read(JOURNAL)
    restore(spark, data, j["backup"], j["new"], j["before"])
    return True


def update(spark: SparkSession, release: str, data: str, required: list[str], optional: list[str] = (), ready: Callable[[], None] | None = None) -> str:
    """Verify ``release``, swap it into ``data`` and call ``ready``; on any failure ``data`` is as before and the failure is raised. Returns the version."""
    recover(spark, data)
    version = verify(spark, release, required)
    tables = [*required, *optional]
    at = Files(spark, data)
    before = [t for t in tables if at.exists(t)]
    new = [t for t in tables if Files(spark, release).exists(t)]
    backup = None
    try:
        backup = swap(spark, release, data, tables)
        if ready:
            ready()
    except Exception:
        if backup:
            restore(spark, data, backup, new, [t for t in before if t in new])
        else:
            recover(spark, data)
        raise
    Files(spark, backup).drop()
    return version
