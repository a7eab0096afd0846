"""Lifecycles of findings and runs, a case each."""

import random

from pyspark.sql import functions as F

from corvane.operators import lifecycle as L

ROWS = "id string, type string, status string, details string, at long"
EVENTS = "id string, at long, seq long, kind string, text string, permanent boolean"


def after(spark, *events, by_type=(), status="pending"):
    rows = spark.createDataFrame([("a", "t", status, "d", 0), ("b", "t", "pending", "d", 0)], ROWS)
    bulk = spark.createDataFrame(list(by_type), "type string, at long, seq long, text string, permanent boolean")
    out = {r["id"]: r for r in L.findings(rows, spark.createDataFrame(list(events), EVENTS), bulk).collect()}
    return out["a"], out["b"]


def test_first_dismissal_wins_and_only_soft_ones_are_lifted(spark):
    a, b = after(spark, ("a", 1, 1, "dismiss", "no", True), ("a", 2, 2, "dismiss", "again", False), ("a", 3, 3, "undismiss", None, None))
    assert (a.status, a.dismissal, a.reason) == ("dismissed", "permanent", "no") and (b.status, b.dismissal) == ("pending", None)
    a, _ = after(spark, ("a", 1, 1, "dismiss", "no", False), ("a", 3, 3, "undismiss", None, None), ("a", 4, 4, "dismiss", "for good", True))
    assert (a.dismissal, a.reason) == ("permanent", "for good")


def test_update_and_reopen_by_status(spark):
    a, _ = after(spark, ("a", 1, 1, "resolve", "done", None), ("a", 2, 2, "update", "late", None), ("a", 3, 3, "reopen", "no", None))
    assert (a.status, a.details, a.action, a.resolved, a.updated) == ("resolved", "d", "done", 1, 1)
    a, _ = after(spark, ("a", 2, 2, "update", "new", None), ("a", 3, 3, "dismiss", "x", False), ("a", 4, 4, "reopen", "back", None))
    assert (a.status, a.details, a.action, a.dismissal) == ("pending", "back", None, "soft")


def test_a_whole_type_dismisses_what_is_pending_at_that_time(spark):
    a, b = after(spark, ("a", 1, 1, "resolve", "done", None), ("b", 9, 9, "reopen", "late", None), by_type=[("t", 5, 5, "bulk", True), ("u", 5, 5, "other", True)])
    assert (a.status, a.dismissal) == ("resolved", None) and (b.status, b.details, b.dismissal, b.reason) == ("pending", "late", "permanent", "bulk")


def test_events_count_by_time_then_number(spark):
    a, _ = after(spark, ("a", 5, 2, "resolve", "second", None), ("a", 5, 1, "resolve", "first", None), ("z", 1, 1, "resolve", "no row", None))
    assert a.action == "second"


def test_runs(spark):
    rows = spark.createDataFrame([(1, "t", 0, 5), (2, "t", 0, None), (3, "t", 50, 1)], "id long, type string, at long, total long")
    events = [(1, 3, 1, "progress", 4, 2, "c4"), (1, 4, 2, "complete", None, 3, None), (2, 6, 1, "progress", 1, 1, "c1"), (3, 51, 1, "fail", None, None, "bad")]
    events = spark.createDataFrame(events, "id long, at long, seq long, kind string, n long, made long, text string")
    out = {r["id"]: r for r in L.runs(rows, events, spark.createDataFrame([(20,), (10,), (None,)], "at long")).collect()}
    assert (out[1].status, out[1].completed, out[1].processed, out[1].created, out[1].cursor, out[1].total) == ("completed", 4, 4, 3, "c4", 5)
    assert (out[2].status, out[2].completed, out[2].error, out[2].cursor) == ("failed", 10, L.STALE, "c1")
    assert (out[3].status, out[3].error, out[3].completed) == ("failed", "bad", 51)
    none = L.runs(rows, events.limit(0), spark.createDataFrame([], "at long")).collect()
    assert {r["status"] for r in none} == {"running"}


def test_next_marks_are_the_first_at_or_after(spark):
    draw = random.Random(3)
    points = [(k, draw.choice("aab"), draw.randrange(500)) for k in range(300)] + [(900, None, 3), (901, "c", 3)]
    marks = [(draw.choice("aab"), draw.randrange(480)) for _ in range(25)] + [(None, 4)]
    got = L.next_marks(spark.createDataFrame(points, "id long, t string, at long"), spark.createDataFrame(marks, "t string, at long"), "t", ["at"])
    want = {i: min([m for u, m in marks if u == t and m >= at], default=None) for i, t, at in points if t}
    assert sorted(map(tuple, got.collect())) == sorted((i, m) for i, m in want.items() if m is not None)


def test_events_of_a_whole_type_do_not_multiply(spark, monkeypatch):
    """2,000 findings and 500 dismissals of their type: a finding gets the first of them, and one more after each reopening."""
    rows = spark.range(2_000).select(F.concat(F.lit("f"), "id").alias("id"), F.lit("t").alias("type"), F.lit("pending").alias("status"), F.lit("d").alias("details"), F.lit(0).cast("long").alias("at"))
    events = rows.select("id", F.lit(7001).cast("long").alias("at"), F.lit(1).cast("long").alias("seq"), F.lit("reopen").alias("kind"), F.lit("back").alias("text"), F.lit(None).cast("boolean").alias("permanent"))
    bulk = spark.range(1, 501).select(F.lit("t").alias("type"), (F.col("id") * 20).alias("at"), F.lit(9).cast("long").alias("seq"), F.concat(F.lit("b"), "id").alias("text"), F.lit(True).alias("permanent"))
    folded, fold = [], L.fold
    monkeypatch.setattr(L, "fold", lambda rows, events, *more: folded.append(events) or fold(rows, events, *more))
    out = L.findings(rows, events, bulk).collect()
    assert {(r["status"], r["details"], r["updated"], r["reason"]) for r in out} == {("dismissed", "back", 7020, "b1")}
    assert folded[0].count() == 3 * 2_000
