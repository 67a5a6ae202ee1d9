"""Boxes as struct columns (x1, y1, x2, y2): overlap and continuity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(b: Column, floor: float = 0.0) -> Column:
    return F.greatest(F.lit(floor), (b["x2"] - b["x1"]) * (b["y2"] - b["y1"]))


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def iou(a: Column, b: Column, area_floor: float = 0.0, union_floor: float = 1e-9) -> Column:
    """The callers' variants differ in the floors under areas and union."""
    inter = intersection(a, b)
    return inter / F.greatest(F.lit(union_floor), area(a, area_floor) + area(b, area_floor) - inter)


def centre_distance(a: Column, b: Column) -> Column:
    dx = (a["x1"] + a["x2"] - b["x1"] - b["x2"]) / 2
    dy = (a["y1"] + a["y2"] - b["y1"] - b["y2"]) / 2
    return F.sqrt(dx * dx + dy * dy)


def continuous(a: Column, b: Column) -> Column:
    """IoU of 0.08, or centres within 0.45 of the longest side."""
    side = F.greatest(*[x["x2"] - x["x1"] for x in (a, b)], *[x["y2"] - x["y1"] for x in (a, b)])
    return (iou(a, b, 1.0, 1.0) >= 0.08) | (centre_distance(a, b) <= 0.45 * side)


def contains_centre(region: Column, b: Column) -> Column:
    x, y = (b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2
    return x.between(region["x1"], region["x2"]) & y.between(region["y1"], region["y2"])
