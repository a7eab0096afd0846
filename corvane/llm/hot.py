"""Joins that no key can make uneven."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that hold at least 1 / HOT of all rows are sent to all tasks: HOT of them at most.
HOT = 10_000


def join(rows: DataFrame, side: DataFrame, key: str, weight: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``side`` (one row a key; ``weight`` tells how many of the ``total`` rows have it) on ``key``, inner or left.

    Rows of heavy keys, whose number is bounded by arithmetic, are joined where they are; the others are shuffled. A null key
    matches nothing. Both inputs should be read from files, as each is read twice.
    """
    heavy = F.col(weight) * HOT >= total
    some, rest = F.broadcast(side.where(heavy).drop(weight)), side.where(~heavy).drop(weight)
    return rows.join(some, key).union(rows.join(some, key, "left_anti").join(rest, key, how))
