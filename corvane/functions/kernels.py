"""Sampling grids and geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _line(lo: Column, hi: Column, n: int) -> Column:
    """n evenly spaced points from lo to hi; one point lies in the middle."""
    if n <= 1:
        return F.array((lo + hi) / 2)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: lo + i * (hi - lo) / (n - 1))


def bounds(duration: Column, start_share: float = 0.05, end_share: float = 0.95, start: float | None = None, end: float | None = None) -> tuple[Column, Column]:
    lo = F.lit(float(start)) if start is not None else duration * start_share
    hi = duration - end if end is not None else duration * end_share
    return F.greatest(F.lit(0.0), lo), F.least(duration, hi)


def even_grid(duration: Column, n: int, **b) -> Column:
    lo, hi = bounds(duration, **b)
    return F.when(hi <= lo, F.array(duration / 2)).otherwise(_line(lo, hi, n))


def burst_grid(duration: Column, n: int, each: int, spread: float, **b) -> Column:
    """Points of several frames each, spread around them and clamped to the item."""
    lo, hi = bounds(duration, **b)
    offsets = [-spread + 2 * spread * i / (each - 1) for i in range(each)] if each > 1 else [0.0]
    around = lambda p: F.array(*(F.greatest(F.lit(0.0), F.least(duration, p + o)) for o in offsets))
    return F.when(hi <= lo, F.array(duration / 2)).otherwise(F.flatten(F.transform(_line(lo, hi, max(1, n // each)), around)))


def weighted_grid(duration: Column, n: int, front: float = 0.40, back: float = 0.15, front_zone: float = 0.30, back_zone: float = 0.20, skip: float = 15.0, long: float = 300.0, end_share: float = 0.95) -> Column:
    """Three zones of their own density; long items skip their opening."""
    lo, hi = F.when(duration >= long, skip).otherwise(duration * 0.05), F.least(duration, duration * end_share)
    f, b = max(1, round(n * front)), max(1, round(n * back))
    front_end, back_start = lo + (hi - lo) * front_zone, hi - (hi - lo) * back_zone
    zones = F.concat(_line(lo, front_end, f), _line(front_end, back_start, max(1, n - f - b)), _line(back_start, hi, b))
    return F.when(hi <= lo, F.array(duration / 2)).otherwise(F.sort_array(zones))


def iou(a: Column, b: Column) -> Column:
    """Overlap of boxes with x1, y1, x2, y2."""
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    area = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
    return F.coalesce(F.try_divide(w * h, area(a) + area(b) - w * h), F.lit(0.0))


def suppress(boxes: DataFrame, limit: float = 0.45) -> DataFrame:
    """``boxes`` (image, id, score, x1, y1, x2, y2): by score, a box stays if it overlaps no kept one by more than ``limit``.

    The greedy order is a fold over the image's sorted boxes, inside the JVM.
    """
    s = F.struct((-F.col("score")).alias("k"), "id", "score", "x1", "y1", "x2", "y2")
    g = boxes.groupBy("image").agg(F.array_sort(F.collect_list(s)).alias("all"))
    keep = lambda acc, b: F.when(F.exists(acc, lambda o: iou(o, b) > limit), acc).otherwise(F.concat(acc, F.array(b)))
    kept = F.aggregate("all", F.slice("all", 1, 0), keep)
    return g.select("image", F.explode(kept).alias("b")).select("image", "b.id", "b.score")


def location_hint(x: Column, y: Column, w: Column, h: Column) -> Column:
    cx, cy = x + w / 2, y + h / 2
    side = F.when(cx < 0.4, "left").when(cx > 0.6, "right")
    level = F.when(cy < 0.4, "upper body").when(cy > 0.7, "lower body").otherwise("torso")
    return F.when(side.isNull(), level).when(level == "torso", F.concat(side, F.lit(" side"))).otherwise(F.concat_ws(" ", side, level))


def letterbox(w: Column, h: Column, size: int) -> tuple[Column, Column, Column]:
    """Scale and paddings that fit an image into a square."""
    r = F.least(size / h, size / w)
    return r, (size - F.round(w * r)) / 2, (size - F.round(h * r)) / 2


def unletterbox(cx: Column, cy: Column, w: Column, h: Column, r: Column, px: Column, py: Column, iw: Column, ih: Column) -> list[Column]:
    """Corners in the image, clipped and divided by its size, from centre and size in the square."""
    clip = lambda v, hi: F.greatest(F.lit(0.0), F.least(hi, v)) / hi
    return [clip((cx - w / 2 - px) / r, iw), clip((cy - h / 2 - py) / r, ih), clip((cx + w / 2 - px) / r, iw), clip((cy + h / 2 - py) / r, ih)]


def padded_crop(x: Column, y: Column, w: Column, h: Column, iw: Column, ih: Column, pad: float = 0.1) -> list[Column]:
    g, least = F.greatest, F.least
    return [g(F.lit(0), F.floor(x - w * pad)), g(F.lit(0), F.floor(y - h * pad)), least(iw, F.floor(x + w + w * pad)), least(ih, F.floor(y + h + h * pad))]


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / F.nullif(b, F.lit(0.0))).otherwise(0.0)


def span(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def pose_ratios(marks: dict[str, tuple[Column, Column]]) -> dict[str, Column]:
    """Ratios of a body by its landmarks' places (x, y), zero where the denominator is."""
    middle = lambda part: tuple((a + b) / 2 for a, b in zip(marks[f"left_{part}"], marks[f"right_{part}"]))
    wide = lambda part: span(*marks[f"left_{part}"], *marks[f"right_{part}"])
    hips, ankles = middle("hip"), middle("ankle")
    return {
        "shoulder_hip": ratio(wide("shoulder"), wide("hip")), "leg_torso": ratio(span(*hips, *ankles), span(*middle("shoulder"), *hips)),
        "span_height": ratio(wide("wrist"), span(*marks["nose"], *ankles)),
    }


def yaw(nose_x: Column, left_x: Column, right_x: Column) -> Column:
    """Turn of a head in degrees from the nose's place between the eyes."""
    half = F.abs(right_x - left_x) / 2
    return F.degrees(F.atan2(nose_x - (left_x + right_x) / 2, half))


def resolution_tier(w: Column, h: Column) -> Column:
    m = F.greatest(w, h)
    return F.when(m >= 2160, "4k").when(m >= 1080, "1080p").when(m >= 720, "720p").otherwise("480p")
