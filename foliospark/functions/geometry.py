"""Boxes and polygons. Boxes are STRUCT<x, y, width, height> in the unit square, polygons arrays of STRUCT<x, y>."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.score import finite

SLACK = 1e-9


def bbox_valid(b: Column, tolerance: float = SLACK) -> Column:
    """Whether a box is finite and inside the unit square; a null box or side is not."""
    parts = [b[k] for k in ("x", "y", "width", "height")]
    x, y, w, h = parts
    inside = (x >= 0) & (x <= 1) & (y >= 0) & (y <= 1) & (w > 0) & (w <= 1) & (h > 0) & (h <= 1)
    fits = (x + w <= 1 + tolerance) & (y + h <= 1 + tolerance)
    return F.coalesce(reduce(lambda a, c: a & c, [finite(p) for p in parts]) & inside & fits, F.lit(False))


def contains_box(outer: Column, inner: Column, slack: float = SLACK) -> Column:
    """Whether inner lies in outer; false if either is invalid."""
    fits = (
        (inner["x"] >= outer["x"] - slack)
        & (inner["y"] >= outer["y"] - slack)
        & (inner["x"] + inner["width"] <= outer["x"] + outer["width"] + slack)
        & (inner["y"] + inner["height"] <= outer["y"] + outer["height"] + slack)
    )
    return F.coalesce(bbox_valid(outer) & bbox_valid(inner) & fits, F.lit(False))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the union is empty, null where a side is."""
    w = F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"])
    both = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    union = a["width"] * a["height"] + b["width"] * b["height"] - both
    return F.when(union > 0, both / union).when(union.isNotNull(), 0.0)


def pixel_to_unit(corners: Column, width: Column, height: Column) -> Column:
    """A box of an array (left, top, right, bottom) in pixels; null if it has not four values or the page no size."""
    x0, y0, x1, y1 = (F.try_element_at(corners, F.lit(i)) for i in range(1, 5))
    box = F.struct(
        (x0 / width).alias("x"), (y0 / height).alias("y"), ((x1 - x0) / width).alias("width"), ((y1 - y0) / height).alias("height")
    )
    return F.when((F.size(corners) == 4) & (width > 0) & (height > 0), box)


def polygon_bounds(points: Column) -> Column:
    """STRUCT<x_min, y_min, x_max, y_max> of a polygon."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(
        F.array_min(xs).alias("x_min"), F.array_min(ys).alias("y_min"), F.array_max(xs).alias("x_max"), F.array_max(ys).alias("y_max")
    )


def polygon_area(points: Column) -> Column:
    """Area of a polygon by the shoelace formula."""
    n = F.size(points)

    def cross(p: Column, i: Column) -> Column:
        q = F.element_at(points, F.pmod(i + 1, n).cast("int") + 1)
        return p["x"] * q["y"] - q["x"] * p["y"]

    return F.abs(F.aggregate(F.transform(points, cross), F.lit(0.0), lambda s, x: s + x)) / 2


def crop_pixels(b: Column, width: Column, height: Column) -> Column:
    """STRUCT<left, top, right, bottom> in whole pixels: cut off, kept on the page, one pixel at least."""

    def part(x: Column, most: Column) -> Column:
        return F.greatest(F.lit(0), F.least(most - 1, x.cast("int")))

    left, top = part(b["x"] * width, width), part(b["y"] * height, height)
    right = F.greatest(left + 1, F.least(width, ((b["x"] + b["width"]) * width).cast("int")))
    bottom = F.greatest(top + 1, F.least(height, ((b["y"] + b["height"]) * height).cast("int")))
    return F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom"))
