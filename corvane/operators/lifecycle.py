"""Lifecycles of findings and of runs, as folds over the events of a key in their order.

A key's events are sorted structs that a transition expression folds into a state, in one pass and in the JVM. Events that concern many keys (a whole
type dismissed, all running work failed at a restart) become events of a key only where they can change it: the first one after the key's state lets it
(``next_marks``), so they grow with the keys' own events and not with keys times events of all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.runtime import materialise


def fold(rows: DataFrame, events: DataFrame, keys: list[str], order: list[str], start: Column, step: Callable[[Column, Column], Column]) -> DataFrame:
    """``rows`` (one a key) with ``state``: ``start`` (over their columns) after all of the key's ``events``, by ``order`` and then by their other columns.

    Keys without events keep ``start``; events without a row are left out.
    """
    rest = [c for c in events.columns if c not in keys + order]
    packed = events.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias("events"))
    joined = rows.withColumn("state", start).join(packed, keys, "left")
    state = F.when(F.col("events").isNull(), F.col("state")).otherwise(F.aggregate("events", F.col("state"), step))
    return joined.withColumn("state", state).drop("events")


def next_marks(points: DataFrame, marks: DataFrame, by: str, order: list[str]) -> DataFrame:
    """(id, and ``order`` of the mark): for each of ``points`` (id, by, order) the first of ``marks`` (by, order) of the same ``by`` at its place in the order or later; points without one are left out.

    Both are dealt to slices of the order, whatever their ``by``. A slice is searched in one pass backwards, and then by the first marks of the slices behind it, a row for each slice and ``by``.
    """
    here = points.where(F.col(by).isNotNull()).select(F.col("id"), by, *order, F.lit(False).alias("is_mark"))
    both = here.unionByName(marks.where(F.col(by).isNotNull()).select(by, *order, F.lit(True).alias("is_mark")), allowMissingColumns=True)
    dealt = materialise(both.repartitionByRange(by, *order, "is_mark").withColumn("slice", F.spark_partition_id()), "slices")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    own = F.when(F.col("is_mark"), F.struct(*order))
    in_slice = F.last(own, ignorenulls=True).over(before(Window.partitionBy(by, "slice").orderBy(*map(F.desc, [*order, "is_mark"]))))
    firsts = dealt.groupBy(by, "slice").agg(F.min(own).alias("first"))
    behind = firsts.select(by, "slice", F.last("first", ignorenulls=True).over(before(Window.partitionBy(by).orderBy(F.desc("slice")))).alias("behind"))
    found = dealt.withColumn("next", in_slice).where(~F.col("is_mark")).join(behind, [by, "slice"]).select("id", F.coalesce("next", "behind").alias("next"))
    return found.where("next is not null").select("id", "next.*")


def _with(state: Column, names: list[str], **new: Column) -> Column:
    return F.struct(*(new.get(n, state[n]).alias(n) for n in names))


FINDING = ["status", "details", "action", "resolved", "updated", "dismissal", "reason"]


def _finding_step(s: Column, e: Column) -> Column:
    """resolve: always. dismiss: always, and a first dismissal of the target stays as it was. dismiss_pending (of a whole type) and update: pending
    ones alone. reopen: dismissed ones alone; the target's dismissal stays. undismiss: a soft dismissal of the target goes, the status stays."""
    kind, at, nothing = e["kind"], e["at"], F.lit(None).cast("string")
    pending = s["status"] == "pending"
    does = (kind.isin("resolve", "dismiss")) | (kind.isin("update", "dismiss_pending") & pending) | ((kind == "reopen") & (s["status"] == "dismissed"))
    resolve, dismiss, reopen = does & (kind == "resolve"), does & kind.isin("dismiss", "dismiss_pending"), does & (kind == "reopen")
    first = dismiss & s["dismissal"].isNull()
    lifted = (kind == "undismiss") & (s["dismissal"] == "soft")
    return _with(
        s,
        FINDING,
        status=F.when(resolve, "resolved").when(dismiss, "dismissed").when(reopen, "pending").otherwise(s["status"]),
        details=F.when(does & kind.isin("update", "reopen"), e["text"]).otherwise(s["details"]),
        action=F.when(resolve, e["text"]).when(reopen, nothing).otherwise(s["action"]),
        resolved=F.when(resolve, at).when(reopen, F.lit(None)).otherwise(s["resolved"]),
        updated=F.when(does, at).otherwise(s["updated"]),
        dismissal=F.when(first, F.when(e["permanent"], "permanent").otherwise("soft")).when(lifted, nothing).otherwise(s["dismissal"]),
        reason=F.when(first, e["text"]).when(lifted, nothing).otherwise(s["reason"]),
    )


def findings(rows: DataFrame, events: DataFrame, by_type: DataFrame) -> DataFrame:
    """``rows`` (id, type, status, details, at; one a target, so id stands for the target) after ``events`` (id, at, seq, kind, text, permanent) and ``by_type`` (type, at, seq, text,
    permanent), which dismisses all that is pending of a type at that time. Columns: id, type and the parts of the state: status, details, action,
    resolved, updated, and the target's dismissal (null, soft or permanent) with its reason.

    A finding can be pending from its start or from a reopening on, and the first dismissal of its type after that ends it, if nothing else has: later ones, up to the next reopening,
    change nothing. So these first ones alone become its events."""
    order = ["at", "seq", "kind", "text", "permanent"]
    events = events.select("id", *order)
    bulk = by_type.select("type", "at", "seq", F.lit("dismiss_pending").alias("kind"), "text", "permanent")
    reopened = events.where("kind = 'reopen'").join(rows.select("id", "type"), "id").select("id", "type", *order)
    first = bulk.groupBy("type").agg(F.min(F.struct(*order)).alias("first"))
    spread = rows.select("id", "type").join(first, "type").select("id", "first.*").union(next_marks(reopened, bulk, "type", order))
    null = F.lit(None)
    start = F.struct(
        F.col("status").alias("status"),
        F.col("details").alias("details"),
        null.cast("string").alias("action"),
        null.cast(rows.schema["at"].dataType).alias("resolved"),
        F.col("at").alias("updated"),
        null.cast("string").alias("dismissal"),
        null.cast("string").alias("reason"),
    )
    out = fold(rows, events.union(spread), ["id"], ["at", "seq"], start, _finding_step)
    return out.select("id", "type", "state.*")


RUN = ["status", "started", "completed", "total", "processed", "created", "cursor", "error"]
STALE = "restarted while running"


def _run_step(s: Column, e: Column) -> Column:
    """progress and total say how far a run is, whatever its status; complete and fail end it; a restart fails it if it is running."""
    kind = e["kind"]
    stale = (kind == "restart") & (s["status"] == "running")
    ends = kind.isin("complete", "fail") | stale
    made = kind.isin("progress", "complete")
    return _with(
        s,
        RUN,
        status=F.when(kind == "complete", "completed").when((kind == "fail") | stale, "failed").otherwise(s["status"]),
        completed=F.when(ends, e["at"]).otherwise(s["completed"]),
        total=F.when(kind == "total", e["n"]).otherwise(s["total"]),
        processed=F.when(kind == "progress", e["n"]).otherwise(s["processed"]),
        created=F.when(made, e["made"]).otherwise(s["created"]),
        cursor=F.when(kind == "progress", e["text"]).otherwise(s["cursor"]),
        error=F.when(kind == "fail", e["text"]).when(stale, STALE).otherwise(s["error"]),
    )


def runs(rows: DataFrame, events: DataFrame, restarts: DataFrame) -> DataFrame:
    """``rows`` (id, type, at, total), each a run that started, after ``events`` (id, at, seq, kind, n, made, text) and ``restarts`` (at): id, type and status, started, completed,
    total, processed, created, cursor, error.

    Nothing makes a run run again, so of all restarts only the first one after its start can fail it.
    """
    every = F.lit(0).alias("every")
    first = next_marks(rows.where("at is not null").select("id", every, "at"), restarts.select(every, "at").dropna().distinct(), "every", ["at"])
    kinds = dict(events.dtypes)
    stale = first.select("id", "at", F.lit(2**62).cast(kinds["seq"]).alias("seq"), F.lit("restart").alias("kind"), *(F.lit(None).cast(kinds[c]).alias(c) for c in ("n", "made", "text")))
    null = F.lit(None)
    start = F.struct(
        F.lit("running").alias("status"),
        F.col("at").alias("started"),
        null.cast(rows.schema["at"].dataType).alias("completed"),
        F.col("total").cast("long").alias("total"),
        F.lit(0).cast("long").alias("processed"),
        F.lit(0).cast("long").alias("created"),
        null.cast("string").alias("cursor"),
        null.cast("string").alias("error"),
    )
    out = fold(rows, events.select("id", "at", "seq", "kind", "n", "made", "text").union(stale), ["id"], ["at", "seq"], start, _run_step)
    return out.select("id", "type", "state.*")
