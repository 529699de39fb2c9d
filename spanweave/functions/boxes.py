"""Rectangles as Column expressions. A box is a struct of x, y, w and h."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = "struct<x:bigint,y:bigint,w:bigint,h:bigint>"


def box(x, y, w, h) -> Column:
    named = zip("xywh", (x, y, w, h), strict=True)
    return F.struct(*[(F.col(v) if isinstance(v, str) else v).cast("bigint").alias(k) for k, v in named])


def clamp(x: Column, y: Column, w: Column, h: Column, width: int, height: int) -> Column:
    """The pixels of the frame that a rectangle touches; sides of 0 where it lies outside."""
    x1, y1 = F.greatest(F.lit(0), F.floor(x)), F.greatest(F.lit(0), F.floor(y))
    x2, y2 = F.least(F.lit(width), F.ceil(x + w)), F.least(F.lit(height), F.ceil(y + h))
    return box(x1, y1, F.greatest(F.lit(0), x2 - x1), F.greatest(F.lit(0), y2 - y1))


def union(a: Column, b: Column) -> Column:
    x, y = F.least(a["x"], b["x"]), F.least(a["y"], b["y"])
    return box(x, y, F.greatest(a["x"] + a["w"], b["x"] + b["w"]) - x, F.greatest(a["y"] + a["h"], b["y"] + b["h"]) - y)


def union_agg(b: Column) -> Column:
    """The union of a group's boxes, as an aggregate."""
    x, y = F.min(b["x"]), F.min(b["y"])
    return box(x, y, F.max(b["x"] + b["w"]) - x, F.max(b["y"] + b["h"]) - y)


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.greatest(F.lit(0), w) * F.greatest(F.lit(0), h)


def intersects(a: Column, b: Column) -> Column:
    return intersection(a, b) > 0


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; a union of less than 1 counts as 1."""
    common = intersection(a, b)
    return common / F.greatest(F.lit(1), a["w"] * a["h"] + b["w"] * b["h"] - common)


def same_row(a: Column, b: Column) -> Column:
    """Two boxes of one line: they share half the lesser height and .45 of the lesser width, and together stay narrow."""
    high = F.greatest(F.lit(0), F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]))
    wide = F.greatest(F.lit(0), F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]))
    both = union(a, b)["w"]
    return (2 * high >= F.least(a["h"], b["h"])) & (100 * wide >= 45 * F.least(a["w"], b["w"])) & (10 * both <= 16 * F.greatest(a["w"], b["w"]))


def centre_distance(a: Column, b: Column) -> Column:
    return F.hypot((a["x"] + a["w"] / 2) - (b["x"] + b["w"] / 2), (a["y"] + a["h"] / 2) - (b["y"] + b["h"] / 2))


def subtract(a: Column, b: Column) -> Column:
    """What is left of a without b, as up to four boxes: above, below, left, right."""
    top, bottom = F.greatest(a["y"], b["y"]), F.least(a["y"] + a["h"], b["y"] + b["h"])
    left, right = F.greatest(a["x"], b["x"]), F.least(a["x"] + a["w"], b["x"] + b["w"])
    parts = F.array(
        box(a["x"], a["y"], a["w"], top - a["y"]),
        box(a["x"], bottom, a["w"], a["y"] + a["h"] - bottom),
        box(a["x"], top, left - a["x"], bottom - top),
        box(right, top, a["x"] + a["w"] - right, bottom - top),
    )
    return F.when(intersects(a, b), F.filter(parts, lambda p: (p["w"] > 0) & (p["h"] > 0))).otherwise(F.array(box(a["x"], a["y"], a["w"], a["h"])))


def valid(b: Column, width: int, height: int) -> Column:
    """Whether a box of whole pixels lies in the frame and has a size."""
    known = b["x"].isNotNull() & b["y"].isNotNull() & b["w"].isNotNull() & b["h"].isNotNull()
    return known & (b["x"] >= 0) & (b["y"] >= 0) & (b["w"] > 0) & (b["h"] > 0) & (b["x"] + b["w"] <= width) & (b["y"] + b["h"] <= height)
