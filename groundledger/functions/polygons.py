"""Polygons of any shape, with holes: validity, area, and what two of them share.

A polygon is an array of rings, the outer one first; a ring is an array of (x, y)
without its first corner again at the end. Areas work on edges: an outer ring runs
counterclockwise, a hole clockwise, so each edge stands for the strip below it with a
sign, the strips add up to the polygon, and what two polygons share is the signed sum
of what their strips share, pair by pair of edges. No corner of the common part is
needed for that, and neither convexity nor a single piece. All edges of an Arrow batch
are looked at together, as arrays.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from .geometry import geodesic_area

#: Pairs of edges that are looked at together, which bounds a task's arrays.
PAIRS = 1 << 20


def extent(rings: Column) -> Column:
    """The box (x1, y1, x2, y2) around a polygon."""
    points = F.flatten(rings)
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))


def geodesic(rings: Column) -> Column:
    """Square metres of a polygon of degrees on the sphere."""
    holes = F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0)))
    return F.aggregate(holes, geodesic_area(F.get(rings, F.lit(0))), lambda s, ring: s - geodesic_area(ring))


def polygon(*rings: tuple) -> Column:
    """A polygon of given corners."""
    return F.array(*[F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ring]) for ring in rings])


@dataclass
class _Edges:
    """Edges (x1, y1, x2, y2) of a batch's polygons by row, ring and place in it, outer rings counterclockwise, holes clockwise."""

    rows: int
    lines: np.ndarray
    row: np.ndarray
    ring: np.ndarray
    nth: np.ndarray
    corners: np.ndarray
    outer: np.ndarray
    twice: np.ndarray
    ring_row: np.ndarray

    @property
    def at(self) -> np.ndarray:
        return np.searchsorted(self.row, np.arange(self.rows + 1))

    def area(self) -> np.ndarray:
        return np.bincount(self.ring_row, np.where(self.outer, 1, -1) * np.abs(self.twice), self.rows) / 2


def _edges(rings: pa.Array) -> _Edges:
    def sizes(lists: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)

    rows = len(rings)
    many = sizes(rings)
    every = rings.flatten()
    corners = sizes(every)
    points = every.flatten()
    x, y = (points.field(c).to_numpy(zero_copy_only=False) for c in "xy") if len(points) else np.zeros((2, 0))
    ring_row = np.repeat(np.arange(rows), many)
    outer = np.arange(len(corners)) == (np.cumsum(many) - many)[ring_row]
    ring = np.repeat(np.arange(len(corners)), corners)
    first = np.repeat(np.cumsum(corners) - corners, corners)
    nth = np.arange(len(x)) - first
    after = first + (nth + 1) % corners[ring]
    lines = np.stack([x, y, x[after], y[after]])
    u, v = x - x[first], y - y[first]
    twice = np.bincount(ring, u * v[after] - u[after] * v, len(corners))
    back = (twice >= 0) != outer
    lines[:, back[ring]] = lines[:, back[ring]][[2, 3, 0, 1]]
    return _Edges(rows, lines, ring_row[ring], ring, nth, corners, outer, twice, ring_row)


def _chunks(many: np.ndarray):
    """Runs of units of about PAIRS partners: pairs of the unit's number and the partner's number in it."""
    upto = np.cumsum(many)
    cut = np.unique(np.concatenate([np.searchsorted(upto, np.arange(0, int(many.sum()), PAIRS), "right"), [len(many)]]))
    for a, b in zip(np.concatenate([[0], cut[:-1]]), cut, strict=True):
        n = many[a:b]
        yield np.repeat(np.arange(a, b), n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def _strips(e: np.ndarray, f: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """Signed area that the strips between the floor and two edges share, pair by pair."""
    left = np.maximum(np.minimum(e[0], e[2]), np.minimum(f[0], f[2]))
    width = np.minimum(np.maximum(e[0], e[2]), np.maximum(f[0], f[2])) - left
    out = np.zeros(len(left))
    on = np.flatnonzero(width > 0)
    e, f, left, width, floor = e[:, on], f[:, on], left[on], width[on], floor[on]

    def heights(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slope = (s[3] - s[1]) / (s[2] - s[0])
        low = s[1] - floor + slope * (left - s[0])
        return low, low + slope * width

    (a, b), (c, d) = heights(e), heights(f)
    start, end = a - c, b - d
    crossing = start * end < 0
    t = np.where(crossing, start / np.where(crossing, start - end, 1), 0)
    middle = a + t * (b - a)
    lower = np.where(crossing, t * (np.minimum(a, c) + middle) + (1 - t) * (middle + np.minimum(b, d)), np.minimum(a, c) + np.minimum(b, d))
    out[on] = np.sign(e[2] - e[0]) * np.sign(f[2] - f[0]) * lower / 2 * width
    return out


def _shared(rows: int, one: np.ndarray, row1: np.ndarray, two: np.ndarray, row2: np.ndarray) -> np.ndarray:
    """What the edges one and two of each row enclose together; rows are in order."""
    # Everything is measured from a corner of the row, so that places far out keep their precision.
    base = np.zeros((2, rows))
    base[:, row1] = one[:2]
    one, two = one - np.tile(base[:, row1], (2, 1)), two - np.tile(base[:, row2], (2, 1))
    floor = np.zeros(rows)
    np.minimum.at(floor, row1, one[1])
    np.minimum.at(floor, row2, two[1])
    bt = np.searchsorted(row2, np.arange(rows + 1))
    total = np.zeros(rows)
    for i, k in _chunks(np.diff(bt)[row1]):
        row = row1[i]
        total += np.bincount(row, _strips(one[:, i], two[:, k + bt[row]], floor[row]), rows)
    return np.maximum(total, 0.0)


@F.arrow_udf(DoubleType())
def area(rings: pa.Array) -> pa.Array:
    return pa.array(_edges(rings).area())


@F.arrow_udf(DoubleType())
def shared_area(a: pa.Array, b: pa.Array) -> pa.Array:
    """Area that two polygons share; 0 where one has none."""
    one, two = _edges(a), _edges(b)
    return pa.array(_shared(len(a), one.lines, one.row, two.lines, two.row))


def _cross(p: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
    return np.sign((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]))


def _between(p: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Whether r, in line with p and q, lies between them or on them."""
    return ((np.minimum(p, q) <= r) & (r <= np.maximum(p, q))).all(0)


def _bad_pairs(e: np.ndarray, f: np.ndarray, beside: np.ndarray, same_ring: np.ndarray) -> np.ndarray:
    """Which pairs of edges a valid polygon can't have."""
    p, q, r, s = e[:2], e[2:], f[:2], f[2:]
    a, b, c, d = _cross(p, q, r), _cross(p, q, s), _cross(r, s, p), _cross(r, s, q)
    crossing = (a * b < 0) & (c * d < 0)
    touching = (a == 0) & _between(p, q, r) | (b == 0) & _between(p, q, s) | (c == 0) & _between(r, s, p) | (d == 0) & _between(r, s, q)
    # In one line they share more than a corner if their boxes share more than a point.
    shared = np.minimum(np.maximum(p, q), np.maximum(r, s)) - np.maximum(np.minimum(p, q), np.minimum(r, s))
    along = (a == 0) & (b == 0) & (shared >= 0).all(0) & (shared > 0).any(0)
    # Neighbours meet in their corner, and a hole may touch another ring in a point.
    return crossing | along | (touching & same_ring & ~beside)


def _crossing(e: _Edges) -> np.ndarray:
    """Whether edges of a polygon cross, or touch where they must not: a sweep along x over each polygon's edges."""
    out = np.zeros(e.rows, bool)
    low, high = np.minimum(e.lines[0], e.lines[2]), np.maximum(e.lines[0], e.lines[2])
    order = np.lexsort((low, e.row))
    lines, ring, nth, row, high, low = e.lines[:, order], e.ring[order], e.nth[order], e.row[order], high[order], low[order]
    # Of the edges that start no later than another one ends, those behind it in the order are its partners.
    n = len(low)
    events = np.lexsort((np.repeat([0, 1], n), np.concatenate([low, high]), np.tile(row, 2)))
    ends = np.empty(2 * n, np.int64)
    ends[events] = np.cumsum(events < n)
    for i, k in _chunks(ends[n:] - np.arange(1, n + 1)):
        j = i + 1 + k
        same = ring[i] == ring[j]
        apart = np.abs(nth[i] - nth[j])
        beside = same & ((apart == 1) | (apart == e.corners[ring[i]] - 1))
        out[row[i][_bad_pairs(lines[:, i], lines[:, j], beside, same)]] = True
    return out


@F.arrow_udf(StringType())
def polygon_fault(rings: pa.Array) -> pa.Array:
    """What makes a polygon invalid, or null: no ring, a ring of two corners or fewer, crossing rings, no area, a hole outside or in a hole."""
    e = _edges(rings)
    none = np.bincount(e.ring_row, minlength=e.rows) == 0
    few = np.bincount(e.ring_row, e.corners < 3, e.rows) > 0
    hole = ~e.outer[e.ring]
    # Each hole counterclockwise, so that what they share adds up instead of cancelling out.
    inner, inner_row = e.lines[:, hole][[2, 3, 0, 1]], e.row[hole]
    taken = np.bincount(e.ring_row, np.where(e.outer, 0, np.abs(e.twice)), e.rows) / 2
    inside = _shared(e.rows, e.lines[:, ~hole], e.row[~hole], inner, inner_row)
    twice = _shared(e.rows, inner, inner_row, inner, inner_row)
    flat = np.bincount(e.ring_row, np.where(e.outer, np.abs(e.twice), 0), e.rows) <= 0
    slack = taken * 1e-9
    faults = [none, few, _crossing(e), flat, taken - inside > slack, twice - taken > slack]
    names = ["no geometry", "too few corners", "crosses itself", "no area", "hole outside", "holes overlap"]
    found = np.select(faults, np.arange(len(names)), len(names))
    return pa.array([*names, None]).take(pa.array(found))
