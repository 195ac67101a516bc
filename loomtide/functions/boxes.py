"""Bounding boxes as array<struct<box: array<double>, label: bigint>> columns: the fields of an object stay together."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import at


def convert(box: Column, source: str, target: str) -> Column:
    """Between xyxy, xywh and cxcywh."""
    a, b, c, d = (at(box, k) for k in range(4))
    x1, y1, x2, y2 = {"xyxy": (a, b, c, d), "xywh": (a, b, a + c, b + d), "cxcywh": (a - c / 2, b - d / 2, a + c / 2, b + d / 2)}[source]
    w, h = x2 - x1, y2 - y1
    return F.array(*{"xyxy": (x1, y1, x2, y2), "xywh": (x1, y1, w, h), "cxcywh": (x1 + w / 2, y1 + h / 2, w, h)}[target])


def _within(x: Column, size: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), size.cast("double"))


def clamp(box: Column, width: Column, height: Column) -> Column:
    """An xyxy box inside 0..width, 0..height."""
    return F.array(_within(at(box, 0), width), _within(at(box, 1), height), _within(at(box, 2), width), _within(at(box, 3), height))


def good(box: Column, width: Column, height: Column, min_size: float = 1.0, min_area: float = 1.0) -> Column:
    w, h = at(box, 2) - at(box, 0), at(box, 3) - at(box, 1)
    inside = (at(box, 0) >= 0) & (at(box, 1) >= 0) & (at(box, 2) <= width) & (at(box, 3) <= height)
    return (w >= min_size) & (h >= min_size) & (w * h >= min_area) & inside


def sanitize(objects: Column, width: Column, height: Column, min_size: float = 1.0, min_area: float = 1.0) -> Column:
    """The objects whose box is large enough and inside the image, with all their fields."""
    return F.filter(objects, lambda o: good(o["box"], width, height, min_size, min_area))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two xyxy boxes; 0 where both are empty."""
    w = F.greatest(F.least(at(a, 2), at(b, 2)) - F.greatest(at(a, 0), at(b, 0)), F.lit(0.0))
    h = F.greatest(F.least(at(a, 3), at(b, 3)) - F.greatest(at(a, 1), at(b, 1)), F.lit(0.0))
    area = lambda x: (at(x, 2) - at(x, 0)) * (at(x, 3) - at(x, 1))
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / F.when(union > 0, union).otherwise(F.lit(1.0))).otherwise(F.lit(0.0))


def horizontal_flip(box: Column, width: Column) -> Column:
    return F.array(width - at(box, 2), at(box, 1), width - at(box, 0), at(box, 3))


def flip_keypoint(x: Column, width: Column) -> Column:
    """Keypoints are pixel centres, so they turn about width - 1."""
    return width - 1 - x


def crop(box: Column, x: float, y: float, w: float, h: float) -> Column:
    moved = F.array(at(box, 0) - x, at(box, 1) - y, at(box, 2) - x, at(box, 3) - y)
    return clamp(moved, F.lit(float(w)), F.lit(float(h)))


def resize(box: Column, sx: Column, sy: Column) -> Column:
    return F.array(at(box, 0) * sx, at(box, 1) * sy, at(box, 2) * sx, at(box, 3) * sy)
