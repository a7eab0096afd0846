"""State tables without a database: next states are computed from old rows and requests, then written aside and swapped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.runtime import scratch_dir


def optional(df: DataFrame, **wanted) -> DataFrame:
    """Equality filters, of which empty ones are skipped."""
    for c, v in wanted.items():
        if v:
            df = df.where(F.col(c) == v)
    return df


def page(df: DataFrame, limit: int, offset: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def insert_if_absent(old: DataFrame, new: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """``old`` with those rows of ``new`` whose keys it lacks; the first by ``order`` of equal new keys."""
    first = new.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_k = 1").drop("_k")
    return old.unionByName(first.join(old.select(*keys), keys, "left_anti"))


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def upsert_non_null(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join; a new value counts unless it is null."""
    rest = [c for c in old.columns if c not in keys]
    n = new.select(*keys, *(F.col(c).alias(f"_n_{c}") for c in rest))
    return old.join(n, keys, "full_outer").select(*keys, *(F.coalesce(f"_n_{c}", c).alias(c) for c in rest))


def swap_in(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Replace the table at ``path``: write aside, then rename; a failure before leaves the old table whole."""
    aside = scratch_dir(spark, "aside")
    df.write.parquet(aside)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at, new = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(aside)
    old = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.old")
    fs = at.getFileSystem(conf)
    fs.delete(old, True)
    if fs.exists(at):
        fs.rename(at, old)
    if not fs.rename(new, at):
        raise OSError(f"could not move {aside} to {path}")
    fs.delete(old, True)


def dispatch(jobs: DataFrame, slots: DataFrame) -> DataFrame:
    """Queued jobs (resource, priority, created, id, status) that the free slots of their resource take, by priority."""
    running = jobs.where("status = 'running'").groupBy("resource").agg(F.count("*").alias("used"))
    free = slots.join(running, "resource", "left").select("resource", (F.col("slots") - F.coalesce("used", F.lit(0))).alias("free"))
    w = Window.partitionBy("resource").orderBy("priority", "created", "id")
    return jobs.where("status = 'queued'").withColumn("k", F.row_number().over(w)).join(F.broadcast(free), "resource").where("k <= free")


def must_yield(jobs: DataFrame) -> DataFrame:
    """Running jobs for whose resource a queued job of smaller priority waits."""
    best = jobs.where("status = 'queued'").groupBy("resource").agg(F.min("priority").alias("best"))
    return jobs.where("status = 'running'").join(best, "resource").where("best < priority")


def setting(override: Column, tier: Column, fallback, low, high) -> Column:
    """The first of override, tier default and fallback; an override out of range does not count."""
    n = override.try_cast("double")
    return F.coalesce(F.when(n.between(low, high), n), tier.cast("double"), F.lit(float(fallback)))


def queue_order(jobs: DataFrame) -> DataFrame:
    """The whole queue with each job's place: ranks within a (priority, month of creation) plus what lies before, so that no task sorts all.

    Only the counts of these cells, few rows, are summed in one task."""
    cell = ["priority", F.date_trunc("month", "created").alias("month")]
    rows = jobs.where("status = 'queued'").select("*", cell[1])
    w = Window.orderBy("priority", "month").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("priority", "month").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).drop("n")
    within = F.row_number().over(Window.partitionBy("priority", "month").orderBy("created", "id"))
    return rows.withColumn("within", within).join(before, ["priority", "month"]).withColumn("place", (F.col("before") + F.col("within")).cast("long")).drop("within", "before", "month")


def submit(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests`` (type, ...) with answer: rejected where a job of the type is queued, running or stopping, else queued. Of several requests of
    one type the first by their other columns is queued."""
    busy = jobs.where(F.col("status").isin("queued", "running", "stopping")).select("type").distinct().withColumn("_busy", F.lit(True))
    first = Window.partitionBy("type").orderBy(*[c for c in requests.columns if c != "type"] or ["type"])
    nth = requests.withColumn("_nth", F.row_number().over(first)).join(busy, "type", "left")
    return nth.withColumn("answer", F.when(F.col("_busy").isNotNull() | (F.col("_nth") > 1), "rejected").otherwise("queued")).drop("_busy", "_nth")


def transition(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """``jobs`` (id, status, started, completed, error) after ``changes`` (id, action, at, message), one for a job at most: start,
    complete, fail with a message, cancel, or stop; jobs without a change stay."""
    j = jobs.join(changes.select("id", "action", "at", "message"), "id", "left")
    status = F.coalesce(F.create_map(*(F.lit(x) for pair in (("start", "running"), ("complete", "completed"), ("fail", "failed"), ("cancel", "cancelled"), ("stop", "stopping")) for x in pair))[F.col("action")], F.col("status"))
    ended = F.col("action").isin("complete", "fail", "cancel")
    return j.select(
        "id", status.alias("status"), F.when(F.col("action") == "start", F.col("at")).otherwise(F.col("started")).alias("started"),
        F.when(ended, F.col("at")).otherwise(F.col("completed")).alias("completed"), F.when(F.col("action") == "fail", F.col("message")).otherwise(F.col("error")).alias("error"),
    )


def requeue_interrupted(jobs: DataFrame) -> DataFrame:
    """``jobs`` after a restart: running and stopping ones are queued again, without times and progress."""
    cut = F.col("status").isin("running", "stopping")
    blank = {c: F.when(~cut, F.col(c)) for c in ("started", "completed", "items_total") if c in jobs.columns}
    if "items_processed" in jobs.columns:
        blank["items_processed"] = F.when(cut, 0).otherwise(F.col("items_processed"))
    return jobs.withColumns(blank | {"status": F.when(cut, "queued").otherwise(F.col("status"))})


def purge_terminal(jobs: DataFrame) -> DataFrame:
    """``jobs`` without those that completed, failed or were cancelled."""
    return jobs.where(~F.col("status").isin("completed", "failed", "cancelled"))
