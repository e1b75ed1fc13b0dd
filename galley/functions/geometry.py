"""Boxes as (x, y, width, height) columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    """Four columns; ``Box.of("r")`` takes r.x, r.y, r.w and r.h, ``Box.of()`` plain x, y, w and h."""

    x: Column
    y: Column
    w: Column
    h: Column

    @staticmethod
    def of(alias: str | None = None) -> Box:
        prefix = f"{alias}." if alias else ""
        return Box(*(F.col(f"{prefix}{c}") for c in "xywh"))

    @property
    def x2(self) -> Column:
        return self.x + self.w

    @property
    def y2(self) -> Column:
        return self.y + self.h

    @property
    def area(self) -> Column:
        return self.w.cast("double") * self.h

    @property
    def cx(self) -> Column:
        return self.x + self.w / F.lit(2.0)

    @property
    def cy(self) -> Column:
        return self.y + self.h / F.lit(2.0)

    def holds(self, x: Column, y: Column) -> Column:
        """A point inside, edges included."""
        return (x >= self.x) & (x <= self.x2) & (y >= self.y) & (y <= self.y2)

    def inside(self, other: Box) -> Column:
        return (self.x >= other.x) & (self.y >= other.y) & (self.x2 <= other.x2) & (self.y2 <= other.y2)


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 for boxes without area."""
    w = F.greatest(F.lit(0), F.least(a.x2, b.x2) - F.greatest(a.x, b.x))
    h = F.greatest(F.lit(0), F.least(a.y2, b.y2) - F.greatest(a.y, b.y))
    both = w.cast("double") * h
    union = a.area + b.area - both
    return F.when((both > 0) & (union > 0), both / union).otherwise(F.lit(0.0))


def overlap_ratio(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Overlap of two intervals over the shorter one (at least 1)."""
    over = F.greatest(F.lit(0), F.least(a2, b2) - F.greatest(a1, b1))
    return over / F.greatest(F.lit(1), F.least(a2 - a1, b2 - b1)).cast("double")


def _clamped(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Box:
    x, y = F.greatest(F.lit(0), F.least(x, width - 1)), F.greatest(F.lit(0), F.least(y, height - 1))
    return Box(x, y, F.greatest(F.lit(1), F.least(w, width - x)), F.greatest(F.lit(1), F.least(h, height - y)))


def clamp(box: Box, width: Column, height: Column) -> Box:
    """A box held inside an image; at least one pixel of it."""
    return _clamped(box.x, box.y, box.w, box.h, width, height)


def pad(box: Box, by: Column, width: Column, height: Column) -> Box:
    """A box grown on all sides, held inside the image."""
    x, y = F.greatest(F.lit(0), box.x - by), F.greatest(F.lit(0), box.y - by)
    x2, y2 = F.least(width, box.x2 + by), F.least(height, box.y2 + by)
    return _clamped(x, y, F.greatest(F.lit(1), x2 - x), F.greatest(F.lit(1), y2 - y), width, height)


def union(a: Box, b: Box) -> Box:
    x, y = F.least(a.x, b.x), F.least(a.y, b.y)
    return Box(x, y, F.greatest(a.x2, b.x2) - x, F.greatest(a.y2, b.y2) - y)
