"""Polygons as arrays of (x, y), boxes as four numbers: areas, overlaps, transforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import planar_area

#: The mean radius of the Earth in metres; metres of a degree; what a degree of longitude is of one of latitude in the region.
EARTH, DEGREE, EAST_WEST = 6_371_008.8, 111_320.0, 0.893


def rectangle(x: Column, y: Column, width: Column, height: Column) -> Column:
    corner = [(x, y), (x + width, y), (x + width, y + height), (x, y + height)]
    return F.array(*[F.struct(a.cast("double").alias("x"), b.cast("double").alias("y")) for a, b in corner])


def _after(ring: Column) -> Column:
    return F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))


def geodesic_area(ring: Column) -> Column:
    """Square metres of a polygon of degrees on the sphere; edges run along straight lines of the chart."""
    part = F.zip_with(ring, _after(ring), lambda p, q: F.radians(q["x"] - p["x"]) * (2 + F.sin(F.radians(p["y"])) + F.sin(F.radians(q["y"]))))
    return F.abs(F.aggregate(part, F.lit(0.0), lambda s, x: s + x)) * (EARTH * EARTH / 2)


def local_area(ring: Column) -> Column:
    """Square metres of a small polygon of degrees on the plane."""
    return planar_area(ring) * (DEGREE * DEGREE * EAST_WEST)


def from_local(x: Column, y: Column, lon: float, lat: float) -> Column:
    """Degrees of a place x metres east and y metres north of (lon, lat)."""
    return F.struct(
        (F.lit(lon) + x / (F.lit(DEGREE) * F.cos(F.radians(F.lit(lat))))).alias("x"),
        (F.lit(lat) + y / DEGREE).alias("y"),
    )


def boxes_meet(a: Column, b: Column) -> Column:
    return (a["x1"] < b["x2"]) & (b["x1"] < a["x2"]) & (a["y1"] < b["y2"]) & (b["y1"] < a["y2"])


def overlap_share(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Of two box structs: how much of b lies in a, of a in b, and their common part over the whole."""
    w = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0.0))
    h = F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), F.lit(0.0))
    size = [(x["x2"] - x["x1"]) * (x["y2"] - x["y1"]) for x in (a, b)]
    both = w * h
    zero = F.lit(0.0)
    return tuple(F.coalesce(F.try_divide(both, n), zero) for n in (size[1], size[0], size[0] + size[1] - both))


def thousandths(value: Column, size: Column) -> Column:
    """A place on a page as thousandths of its size, cut to whole ones and to the page."""
    return F.greatest(F.least((1000 * value / size).cast("int"), F.lit(1000)), F.lit(0))


def moved_box(box: Column, m: list[Column]) -> Column:
    """The whole-numbered box around an affine image (x, y) -> (m0 x + m1 y + m2, m3 x + m4 y + m5) of a box struct."""
    corners = [(box[x], box[y]) for x in ("x1", "x2") for y in ("y1", "y2")]
    xs = [m[0] * x + m[1] * y + m[2] for x, y in corners]
    ys = [m[3] * x + m[4] * y + m[5] for x, y in corners]
    tiny = 1e-6
    return F.struct(
        F.floor(F.least(*xs) + tiny).cast("int").alias("x1"), F.floor(F.least(*ys) + tiny).cast("int").alias("y1"),
        F.ceil(F.greatest(*xs) - tiny).cast("int").alias("x2"), F.ceil(F.greatest(*ys) - tiny).cast("int").alias("y2"),
    )
