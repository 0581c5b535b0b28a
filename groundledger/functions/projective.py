"""Projective maps of the plane, as a page photographed at an angle has them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _unit_map(p: list[tuple[Column, Column]]) -> tuple[list[Column], Column, Column]:
    """The map of the unit square's corners (0,0), (1,0), (1,1), (0,1) to four places: x, y and its two perspective parameters.

    With g and h known, the other six are differences of the places; g and h follow
    from where the diagonal corner lies against the parallelogram of the other three.
    """
    (x0, y0), (x1, y1), (x2, y2), (x3, y3) = p
    ax, ay, bx, by = x1 - x2, y1 - y2, x3 - x2, y3 - y2
    sx, sy = x0 - x1 + x2 - x3, y0 - y1 + y2 - y3
    whole = ax * by - bx * ay
    g, h = F.try_divide(sx * by - bx * sy, whole), F.try_divide(ax * sy - sx * ay, whole)
    return [x1 - x0 + g * x1, x3 - x0 + h * x3, x0, y1 - y0 + g * y1, y3 - y0 + h * y3, y0], g, h


def page_map(corners: list[tuple[Column, Column]], width: Column, height: Column) -> list[Column]:
    """The eight parameters (a, b, c, d, e, f, g, h) of (x, y) -> ((ax + by + c) / w, (dx + ey + f) / w), w = gx + hy + 1.

    corners are where the page's own corners lie, from the top left one clockwise. Null
    where three of them are in line.
    """
    (a, b, c, d, e, f), g, h = _unit_map(corners)
    return [a / width, b / height, c, d / width, e / height, f, g / width, h / height]


def inverse_map(m: list[Column]) -> list[Column]:
    """The map back."""
    a, b, c, d, e, f, g, h = m
    last = a * e - b * d
    rows = [e - f * h, c * h - b, b * f - c * e, f * g - d, a - c * g, c * d - a * f, d * h - e * g, b * g - a * h]
    return [F.try_divide(x, last) for x in rows]


def projected(m: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    a, b, c, d, e, f, g, h = m
    w = g * x + h * y + 1
    return F.try_divide(a * x + b * y + c, w), F.try_divide(d * x + e * y + f, w)


def projected_box(m: list[Column], box: Column) -> Column:
    """The whole-numbered box (x1, y1, x2, y2) around the image of a box struct's corners."""
    places = [projected(m, box[x], box[y]) for x in ("x1", "x2") for y in ("y1", "y2")]
    xs, ys = zip(*places, strict=True)
    tiny = 1e-6
    return F.struct(
        F.floor(F.least(*xs) + tiny).cast("int").alias("x1"), F.floor(F.least(*ys) + tiny).cast("int").alias("y1"),
        F.ceil(F.greatest(*xs) - tiny).cast("int").alias("x2"), F.ceil(F.greatest(*ys) - tiny).cast("int").alias("y2"),
    )
