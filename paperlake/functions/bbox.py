"""Axis-aligned boxes as four columns x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    return tuple(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2"))  # type: ignore[return-value]


def area(a: Box) -> Column:
    return F.greatest(F.lit(0), a[2] - a[0]) * F.greatest(F.lit(0), a[3] - a[1])


def intersection(a: Box, b: Box) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(F.lit(0), w) * F.greatest(F.lit(0), h)


def iou_pct(a: Box, b: Box, decimals: int = 2) -> Column:
    """Intersection over union in percent; 0 for two empty boxes."""
    inter = intersection(a, b)
    union = area(a) + area(b) - inter
    return F.when(union > 0, F.round(100.0 * inter / union, decimals)).otherwise(F.lit(0.0))


def enclosing_iou(a: Box, b: Box) -> Column:
    """Intersection over the smallest box around both."""
    around = (F.greatest(a[2], b[2]) - F.least(a[0], b[0])) * (F.greatest(a[3], b[3]) - F.least(a[1], b[1]))
    return F.when(around > 0, intersection(a, b) / around).otherwise(F.lit(0.0))


def overlaps(a: Box, b: Box) -> Column:
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])


def contains(outer: Box, inner: Box, tolerance: float = 0) -> Column:
    return (inner[0] >= outer[0] - tolerance) & (inner[1] >= outer[1] - tolerance) & (inner[2] <= outer[2] + tolerance) & (inner[3] <= outer[3] + tolerance)


def to_xywh(a: Box) -> list[Column]:
    return [a[0].alias("x"), a[1].alias("y"), (a[2] - a[0]).alias("w"), (a[3] - a[1]).alias("h")]


def envelope() -> list[Column]:
    """Aggregates: the box around a group's boxes."""
    return [F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2")]


def rescale(a: Box, kx: Column, ky: Column) -> list[Column]:
    """Boxes in other units; a missing ratio is 1."""
    kx, ky = F.coalesce(kx, F.lit(1.0)), F.coalesce(ky, F.lit(1.0))
    return [(a[0] * kx).alias("x1"), (a[1] * ky).alias("y1"), (a[2] * kx).alias("x2"), (a[3] * ky).alias("y2")]
