"""Change feeds as streams: snapshots by key in versions by batch, with a durable place to resume from, progress, and a way to stop."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corvane.runtime import scratch_dir, table


@dataclass(frozen=True)
class Feed:
    """Parquet files that arrive in ``folder``, of which the last row of each key by ``order`` is kept with the columns ``keep``.

    What the feed has seen and made lies in ``home``, below the number of its ``logic``: the stream's checkpoint, and a table for each batch, made from the
    batch and the table of the last batch before it. A table is written aside and renamed, so a batch that was lost after its
    table was there makes the same table again. Another ``logic`` begins anew: checkpoints and tables of other numbers are removed, and all files are read again.
    """

    spark: SparkSession
    folder: str
    schema: StructType
    keys: tuple[str, ...]
    order: str
    keep: tuple[str, ...]
    home: str
    logic: int = 1
    change: Callable[[DataFrame], DataFrame] = staticmethod(lambda rows: rows)
    files_a_batch: int = 1

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _names(self, path: str) -> list[str]:
        fs, at = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def _drop(self, path: str) -> None:
        fs, at = self._fs(path)
        fs.delete(at, True)

    @property
    def _own(self) -> str:
        return f"{self.home}/logic-{self.logic}"

    def batches(self) -> list[int]:
        """Numbers of the batches whose tables are there, ascending."""
        return sorted(int(n[1:]) for n in self._names(f"{self._own}/tables") if n.startswith("v"))

    def _merge(self, batch: DataFrame, number: int) -> None:
        rows = self.change(batch).select(*self.keys, self.order, *self.keep)
        before = [n for n in self.batches() if n < number]
        if before:
            rows = rows.unionByName(batch.sparkSession.read.schema(rows.schema).parquet(f"{self._own}/tables/v{before[-1]}"))
        last = F.max_by(F.struct(self.order, *self.keep), self.order).alias("_last")
        aside, to = f"{self._own}/tables/aside-{number}", f"{self._own}/tables/v{number}"
        rows.groupBy(*self.keys).agg(last).select(*self.keys, "_last.*").write.mode("overwrite").parquet(aside)
        self._drop(to)
        fs, at = self._fs(aside)
        if not fs.rename(at, self._fs(to)[1]):
            raise OSError(f"could not move {aside} to {to}")
        for n in before[:-1]:  # the last one before is needed if this batch is run again
            self._drop(f"{self._own}/tables/v{n}")

    def run(self, on_batch: Callable[[int], None] | None = None, on_progress: Callable[[dict], None] | None = None, stop_when: Callable[[], bool] | None = None) -> list[dict]:
        """Read what has arrived since the last run, and return the progress of each batch.

        ``on_batch`` is called with a batch's number when its table is there, before the stream has noted the batch as done; ``on_progress`` with the progress of each
        batch; and when ``stop_when`` holds the stream is stopped. The next run goes on after the last batch that was noted.
        """
        for other in self._names(self.home):
            if other.startswith("logic-") and other != f"logic-{self.logic}":
                self._drop(f"{self.home}/{other}")

        def work(batch: DataFrame, number: int) -> None:
            self._merge(batch, number)
            if on_batch:
                on_batch(number)

        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", self.files_a_batch).parquet(self.folder)
        q = stream.writeStream.foreachBatch(work).option("checkpointLocation", f"{self._own}/checkpoint").trigger(availableNow=True).start()
        told: dict[int, dict] = {}
        while True:
            ended = q.awaitTermination(0.2)
            for p in q.recentProgress:
                if p["batchId"] not in told:
                    told[p["batchId"]] = p
                    if on_progress:
                        on_progress(p)
            if ended:
                return list(told.values())
            if stop_when and stop_when():
                q.stop()

    def read(self) -> DataFrame:
        """The last table, or no rows."""
        found = self.batches()
        if found:
            return self.spark.read.parquet(f"{self._own}/tables/v{found[-1]}")
        return self.change(self.spark.createDataFrame([], self.schema)).select(*self.keys, self.order, *self.keep)


def changes_by_event(spark: SparkSession, sf_dir: str, parts: int = 4) -> DataFrame:
    """The last value of each (user, type) of ``events``, read as a stream of several files."""
    events = table(spark, sf_dir, "events")
    folder = scratch_dir(spark, "arrivals")
    events.repartition(parts, "event_id").write.parquet(folder)
    feed = Feed(spark, folder, events.schema, ("user_id", "event_type"), "event_id", ("value",), scratch_dir(spark, "feed"))
    feed.run()
    return feed.read()


def resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed whose files arrive in two parts, read by a run each, and then once more from the start, since its logic has changed (values count in tens)."""
    events, folder, home = table(spark, sf_dir, "events"), scratch_dir(spark, "arrivals"), scratch_dir(spark, "feed")
    feed = Feed(spark, folder, events.schema, ("user_id", "event_type"), "event_id", ("value",), home)
    for half in (0, 1):
        events.where(F.col("event_id") % 2 == half).repartition(2, "event_id").write.mode("append").parquet(folder)
        feed.run()
    tens = Feed(spark, folder, events.schema, feed.keys, feed.order, feed.keep, home, logic=2, change=lambda rows: rows.withColumn("value", F.floor(F.col("value") / 10).cast("double")), files_a_batch=4)
    tens.run()
    return tens.read()


QUERIES = {"t04_t05_t06_stream_snapshots": lambda spark, sf: changes_by_event(spark, sf), "t03_t05_resumed_feed": resumed}
ORACLE_SQL = {
    "t04_t05_t06_stream_snapshots": "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL",
    "t03_t05_resumed_feed": "SELECT user_id, event_type, max(event_id) AS event_id, floor(arg_max(value, event_id) / 10) AS value FROM events GROUP BY ALL",
}
