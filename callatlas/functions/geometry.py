"""Columns over points, boxes and intervals; a box is struct(x1, y1, x2, y2), a point struct(x, y)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x1, y1, x2, y2) -> Column:
    return F.struct(*[F.bround(v, 0).cast("int").alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), (x1, y1, x2, y2), strict=True)])


def area(b: Column) -> Column:
    side = lambda low, high: F.greatest(b[high].cast("long") - b[low], F.lit(0).cast("long"))
    return side("x1", "x2") * side("y1", "y2")


def contains(b: Column, p: Column) -> Column:
    return (p["x"] >= b["x1"]) & (p["x"] <= b["x2"]) & (p["y"] >= b["y1"]) & (p["y"] <= b["y2"])


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where both are empty."""
    side = lambda low, high: F.greatest(F.least(a[high], b[high]).cast("long") - F.greatest(a[low], b[low]), F.lit(0).cast("long"))
    inter = side("x1", "x2") * side("y1", "y2")
    union = area(a) + area(b) - inter
    return F.when(union <= 0, 0.0).otherwise(inter / union)


def normalised(b: Column, width: Column, height: Column) -> Column:
    return F.array(*[F.bround(b[n] / size, 4) for n, size in zip(("x1", "y1", "x2", "y2"), (width, height, width, height), strict=True)])


def scaled(b: Column, x: Column, y: Column) -> Column:
    """Scaled corners, cut off to whole pixels."""
    return F.struct(*[(b[n] * s).cast("int").alias(n) for n, s in zip(("x1", "y1", "x2", "y2"), (x, y, x, y), strict=True)])


def smoothed(a: Column, b: Column, share: float = 0.3) -> Column:
    return box(*[a[n] + share * (b[n] - a[n]) for n in ("x1", "y1", "x2", "y2")])


def interval_iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Shared time over spanned time; 0 where nothing is spanned."""
    union = F.greatest(e1, e2) - F.least(s1, s2)
    return F.when(union <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(e1, e2) - F.greatest(s1, s2)) / union)


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def crop_window(p: Column, width: Column, height: Column, crop_w: int = 640, crop_h: int = 400) -> Column:
    """A window around a point, moved into the frame; smaller frames give it whole."""
    low = lambda c, size, full: F.greatest(F.lit(0), F.least(c - size // 2, full - size))
    x, y = low(p["x"], crop_w, width), low(p["y"], crop_h, height)
    return F.struct(x.alias("x1"), y.alias("y1"), F.least(x + crop_w, width).alias("x2"), F.least(y + crop_h, height).alias("y2"))


def from_crop(b: Column, window: Column, scale: Column | float = 1.0) -> Column:
    """A box in a crop as a box in the source."""
    return F.struct(*[(window[o] + F.bround(b[n] * scale, 0).cast("int")).alias(n) for n, o in (("x1", "x1"), ("y1", "y1"), ("x2", "x1"), ("y2", "y1"))])
