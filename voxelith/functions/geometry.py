"""Polygons as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = Sequence[float]


def coordinates(polygon) -> list[tuple[float, float]]:
    """A polygon given as a list of points or as {"coordinates": [...]}."""
    points = polygon.get("coordinates", []) if isinstance(polygon, dict) else polygon
    return [(float(p[0]), float(p[1])) for p in points]


def inside_even_odd(x: Column, z: Column, points: Sequence[Point]) -> Column:
    """Whether a ray from (x, z) crosses the polygon's edges an odd number of times.

    An edge counts where one of its ends is above z and the other isn't, so a polygon owns
    its lower and left edges only.
    """
    inside = F.lit(False)
    for (ax, az), (bx, bz) in zip(points, [points[-1], *points[:-1]], strict=True):
        rise = bz - az
        at = (bx - ax) * (z - F.lit(az)) / F.lit(rise if abs(rise) > 1e-12 else 1e-12) + F.lit(ax)
        crossed = ((F.lit(az) > z) != (F.lit(bz) > z)) & (x < at)
        inside = inside != crossed
    return inside


def bounds(points: Sequence[Point]) -> tuple[int, int, int, int]:
    """Floor of the least and ceiling of the largest x, then z."""
    xs, zs = [p[0] for p in points], [p[1] for p in points]
    return math.floor(min(xs)), math.ceil(max(xs)), math.floor(min(zs)), math.ceil(max(zs))


def convex_hull(points: Sequence[Point]) -> list[tuple[float, float]]:
    """Corners in counter-clockwise order; fewer than three if the points lie on a line."""
    points = sorted({(float(x), float(z)) for x, z in points})

    def turn(o, a, b) -> float:
        return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])

    def chain(ordered) -> list:
        out: list = []
        for p in ordered:
            while len(out) > 1 and turn(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return chain(points) + chain(points[::-1]) if len(points) > 2 else points


def inside_convex(x: Column, z: Column, corners: Sequence[Point], slack: float = 1e-9) -> Column:
    """Whether (x, z) lies in or on a counter-clockwise convex polygon."""
    inside = F.lit(True)
    for (ax, az), (bx, bz) in zip(corners, [*corners[1:], corners[0]], strict=True):
        inside = inside & ((F.lit(bx - ax) * (z - F.lit(az)) - F.lit(bz - az) * (x - F.lit(ax))) >= F.lit(-slack))
    return inside
