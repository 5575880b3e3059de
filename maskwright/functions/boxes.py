"""Boxes on a page: structs of x0, y0, x1, y1, open at the right and at the bottom."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x0", "y0", "x1", "y1")


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(*[v.cast("int").alias(n) for n, v in zip(SIDES, (x0, y0, x1, y1), strict=True)])


def area(b: Column) -> Column:
    return F.greatest(b["x1"] - b["x0"], F.lit(0)).cast("long") * F.greatest(b["y1"] - b["y0"], F.lit(0))


def shared_area(a: Column, b: Column) -> Column:
    width = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    height = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(width, F.lit(0)).cast("long") * F.greatest(height, F.lit(0))


def overlaps(a: Column, b: Column, min_share: float = 0.3) -> Column:
    """Whether the shared area is some, and at least a share of the smaller box."""
    shared = shared_area(a, b)
    return (shared > 0) & (shared >= F.least(area(a), area(b)) * min_share)


def union(a: Column, b: Column) -> Column:
    return box(F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]))


def clip_rows(a: Column, rows: Column) -> Column:
    return box(a["x0"], rows["y0"], a["x1"], rows["y1"])


def centre_distance(a: Column, b: Column) -> Column:
    dx = (a["x0"] + a["x1"]) / 2 - (b["x0"] + b["x1"]) / 2
    dy = (a["y0"] + a["y1"]) / 2 - (b["y0"] + b["y1"]) / 2
    return F.sqrt(dx * dx + dy * dy)


def below(upper: Column, lower: Column, line_height: Column | int) -> Column:
    """Whether ``lower`` can go on what ``upper`` begins: the next line of the same block."""
    gap = lower["y0"] - upper["y1"]
    height = F.lit(line_height) if isinstance(line_height, int) else line_height
    return (gap >= -height / 2) & (gap <= height) & (lower["x0"] < upper["x1"]) & (upper["x0"] < lower["x1"])


def scaled(x0: Column, y0: Column, x1: Column, y1: Column, scale: float) -> Column:
    """Points as pixels: the first corner cut, the second rounded half to even."""
    return box((x0 * scale).cast("int"), (y0 * scale).cast("int"), F.rint(x1 * scale), F.rint(y1 * scale))
