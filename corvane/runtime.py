"""Session helpers shared by every part of the package: scratch space and code shipping."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that the cluster shares (``spark.checkpoint.dir``).

    Only where the setting is absent and the master is local, as in tests, a temporary folder takes its place.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = Path(tempfile.mkdtemp(prefix="corvane-")).as_uri()
        sc.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared scratch space and read it back.

    This cuts the lineage with files that survive the loss of an executor, and lets
    several later jobs read the rows without computing them again.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*rows: DataFrame) -> None:
    """Remove the files of materialised rows that nothing reads any more: all that came from them has been written."""
    for df in rows:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Rows that one task holds at a time of those dealt by ``spread``.
ROWS_A_TASK = 500_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` of about ``rows`` rows dealt by a hash of ``keys`` to tasks of ROWS_A_TASK each, so that aggregates by these keys need memory for no more however large the table is.

    Adaptive execution merges small shuffles into tasks by their compressed bytes, of which aggregates and sorts need many times as much; it leaves a given number alone.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK)), *keys)


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each Spark application."""
    sc = spark.sparkContext
    if getattr(sc, "_corvane_shipped", False):
        return
    top = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, f"{top.name}/{p.relative_to(top)}")
    folder = tempfile.mkdtemp(prefix="corvane-code-")
    path = os.path.join(folder, "corvane_code.zip")
    Path(path).write_bytes(data.getvalue())
    sc.addPyFile(path)
    sc._corvane_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
