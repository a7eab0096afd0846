"""Pairs of rows that share a key or a nearby hash, dealt so that no key makes a task large.

A key of n ids is cut into parts of about PART ids by a hash of the id; each pair of parts, a part with itself
included, is a unit of work of bounded size, and units are dealt by their hash. So a key that holds a tenth of all rows becomes many
units of a size, and each pair of its ids is made in one unit alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import comb, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.runtime import materialise, spread

#: Ids in a part, and the share of all rows (1 / HOT) from which a key is sent to all tasks: HOT such keys at most.
PART, HOT = 512, 10_000


def keyed(rows: DataFrame, keys: list[str], id_col: str = "id") -> DataFrame:
    """Distinct (id, key) of rows without a null in either, written once."""
    known = rows.where(F.col(id_col).isNotNull()).dropna(subset=keys)
    return materialise(known.select(F.col(id_col).alias("id"), F.struct(*keys).alias("key")).distinct(), "keyed")


def parted(rows: DataFrame) -> DataFrame:
    """(id, key, part, parts) of (id, key) rows: a key of n ids has n / PART parts, and each id one of them.

    Keys with at least 1 / HOT of all rows learn their number of parts where they are; the others in a shuffle by key.
    """
    counts = rows.groupBy("key").agg(F.count("*").alias("n"))
    total, most = counts.agg(F.sum("n"), F.max("n")).first()
    if (most or 0) <= PART:
        return rows.select("id", "key", F.lit(0).alias("part"), F.lit(1).alias("parts"))
    large = counts.where(F.col("n") > PART).withColumn("parts", F.ceil(F.col("n") / PART).cast("int"))
    hot = F.col("n") * HOT >= total
    some, rest = F.broadcast(large.where(hot).drop("n")), large.where(~hot).drop("n")
    both = rows.join(some, "key").union(rows.join(some, "key", "left_anti").join(rest, "key", "left"))
    parts = F.coalesce("parts", F.lit(1))
    return both.select("id", "key", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), parts.alias("parts"))


def units(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides (key, u, v, id) of all units: an id of part p meets the parts from p on as u, and those up to p as v."""
    dealt = parted(rows)
    left = dealt.select("key", F.col("part").alias("u"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("v"), F.col("id").alias("x"))
    right = dealt.select("key", F.explode(F.sequence(F.lit(0), "part")).alias("u"), F.col("part").alias("v"), F.col("id").alias("y"))
    return left, right


def met(left: DataFrame, right: DataFrame, keys: str | list[str] | Column, how: str = "inner") -> DataFrame:
    """Both joined by a shuffle. Rows that were filed many times, or that compress well, are far larger than Spark's estimate: it would send them whole through the driver."""
    return left.hint("merge").join(right, keys, how)


def self_block(rows: DataFrame, keys: list[str], id_col: str = "id") -> DataFrame:
    """Distinct pairs (a, b), a < b, of ids that share ``keys``; a null id or key meets nothing."""
    held = keyed(rows, keys, id_col)
    n, unit = held.count(), ["key", "u", "v"]
    left, right = (spread(side, n, *unit) for side in units(held))
    pairs = met(left, right, unit).where("u < v or x < y")
    return spread(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")), n, "a", "b").distinct()


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _bit(b: int) -> str:
    return f"(shiftrightunsigned(h, {b}) & 1L)"


@dataclass(frozen=True)
class Band:
    """Bits of a hash, and within how many of them two hashes meet."""

    bits: tuple[int, ...]
    within: int

    def value(self) -> str:
        """The bits of h, side by side."""
        return " | ".join(f"shiftleft({_bit(b)}, {at})" for at, b in enumerate(self.bits))

    def masks(self, flips: int) -> list[int]:
        """Every way to flip at most so many bits."""
        return [sum(1 << b for b in some) for k in range(flips + 1) for some in combinations(range(len(self.bits)), k)]


def ball(width: int, radius: int) -> int:
    return sum(comb(width, k) for k in range(radius + 1))


def bands(n: int, ones: list[int], limit: int, row_cost: float = 20.0) -> list[Band]:
    """Bands for ``n`` hashes of which ``ones`` tells how many have each bit set.

    Two hashes within ``limit`` bits are within ``within`` on one band at least if these numbers and ones for each band sum to more than ``limit``. Bits
    are dealt so that the bands have about the same entropy, since a bit that hardly changes tells nothing. The number of bands is that
    of least cost: rows filed (n times the values near a hash, ``row_cost`` each) and pairs met (n squared times the chance of a common value).
    So wider bands are taken as n grows.
    """
    share = [min(max(x / max(n, 1), 1e-6), 1 - 1e-6) for x in ones]
    entropy = [-(p * log2(p) + (1 - p) * log2(1 - p)) for p in share]
    best: tuple[float, list[Band]] | None = None
    for count in range(1, min(limit + 1, len(ones)) + 1):
        groups: list[list[int]] = [[] for _ in range(count)]
        for b in sorted(range(len(ones)), key=lambda b: -entropy[b]):
            min(groups, key=lambda g: (sum(entropy[x] for x in g), len(g))).append(b)
        spare = limit - count + 1
        groups.sort(key=lambda g: -sum(entropy[x] for x in g))
        found = [Band(tuple(sorted(g)), spare // count + (k < spare % count)) for k, g in enumerate(groups)]
        filed = sum(ball(len(x.bits), (x.within + 1) // 2) + ball(len(x.bits), x.within // 2) for x in found)
        met = sum(min(1.0, ball(len(x.bits), x.within) / 2.0 ** sum(entropy[b] for b in x.bits)) * comb(x.within, x.within // 2) for x in found)
        cost = n * filed * row_cost + n * n * met / 2
        if filed <= 10_000 and (best is None or cost < best[0]):
            best = cost, found
    return best[1]


def hamming_candidates(hashes: DataFrame, found: list[Band]) -> DataFrame:
    """Pairs (hx, hy), hx < hy, of distinct ``hashes`` (h) that meet on a band, once for each way in which they meet.

    Both sides move towards each other: one is filed under all values within half of a band's number, rounded up, the other within the rest.
    """

    def filed(name: str, flips) -> DataFrame:
        calls = [f"transform(array({', '.join(f'{m}L' for m in b.masks(flips(b)))}), m -> named_struct('k', {k}, 'v', v{k} ^ m))" for k, b in enumerate(found)]
        return rows.selectExpr(f"h as {name}", f"explode(concat({', '.join(calls)})) as at").select(name, "at.*")

    rows = materialise(hashes.selectExpr("h", *(f"{b.value()} as v{k}" for k, b in enumerate(found))), "bands")
    return met(filed("hx", lambda b: (b.within + 1) // 2), filed("hy", lambda b: b.within // 2), ["k", "v"]).where("hx < hy").select("hx", "hy")


def hamming_join(hashes: DataFrame, limit: int = 10, bits: int = 64) -> DataFrame:
    """Pairs (a, b, distance), a < b, of (id, h) within ``limit`` bits, all of them; a null id or hash meets nothing.

    Equal hashes are compared with others once; pairs of equal hashes are made in units as those of any shared key.
    """
    rows = keyed(hashes, ["h"])
    each = rows.groupBy(F.col("key.h").alias("h")).agg(F.count("*").alias("n"))
    n, most, *ones = each.selectExpr("count(*)", "max(n)", *(f"sum{_bit(b)}" for b in range(bits))).first()
    near = hamming_candidates(each.select("h"), bands(n, [x or 0 for x in ones], limit)).where(hamming(F.col("hx"), F.col("hy")) <= limit).distinct()
    side = lambda i, h: rows.select(F.col("id").alias(i), F.col("key.h").alias(h))
    ends = [F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")]
    apart = met(met(near, side("x", "hx"), "hx"), side("y", "hy"), "hy").where("x <> y").select(*ends, hamming(F.col("hx"), F.col("hy")).alias("distance"))
    if (most or 0) < 2:
        return apart
    left, right = units(rows)
    return apart.union(met(left, right, ["key", "u", "v"]).where("u < v or x < y").select(*ends, F.lit(0)))
