"""Geometry on arrays: a shape is parts of rings of ``struct<x, y>`` vertices, the first ring of a part its outline."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

GEOMETRY = "array<array<array<struct<x:double,y:double>>>>"
# The WGS84 ellipsoid.
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out once, however often the body names it: a column expression is copied wherever it stands,
    and copies within copies multiply."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def without_repeats(ring: Column) -> Column:
    """A ring without repeated vertices in a row, its closing one included."""
    n = F.size(ring)
    return F.filter(ring, lambda p, i: (n == 1) | (p != F.get(ring, (i + 1) % n)))


def edges(ring: Column) -> Column:
    """array<struct<a, b>>: consecutive vertices; a ring closes itself."""
    n = F.size(ring)
    return F.transform(ring, lambda p, i: F.struct(p.alias("a"), F.get(ring, (i + 1) % n).alias("b")))


def signed_ring_area(ring: Column) -> Column:
    return F.aggregate(edges(ring), F.lit(0.0), lambda t, e: t + (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])) / 2


def part_area(part: Column) -> Column:
    """Outline less holes."""
    return F.aggregate(F.transform(part, lambda r, i: F.abs(signed_ring_area(r)) * F.when(i == 0, 1.0).otherwise(-1.0)), F.lit(0.0), lambda t, x: t + x)


def area(geom: Column) -> Column:
    return F.aggregate(F.transform(geom, part_area), F.lit(0.0), lambda t, x: t + x)


def bounds(geom: Column) -> Column:
    """struct<x0, y0, x1, y1>."""
    v = F.flatten(F.flatten(geom))
    x, y = F.transform(v, lambda p: p["x"]), F.transform(v, lambda p: p["y"])
    return F.struct(F.array_min(x).alias("x0"), F.array_min(y).alias("y0"), F.array_max(x).alias("x1"), F.array_max(y).alias("y1"))


def contains(geom: Column, x: Column, y: Column) -> Column:
    """If the point lies inside: a ray to the right crosses the edges of all rings an odd number of times. Points on a left or lower
    edge are in, on a right or upper one out, so that shapes sharing an edge never both hold a point."""
    def crossed(e: Column) -> Column:
        a, b = e["a"], e["b"]
        at = a["x"] + (y - a["y"]) * (b["x"] - a["x"]) / (b["y"] - a["y"])
        return F.when(((a["y"] > y) != (b["y"] > y)) & (x < at), 1).otherwise(0)

    rings = F.flatten(geom)
    crossings = F.transform(rings, lambda r: F.aggregate(edges(r), F.lit(0), lambda t, e: t + crossed(e)))
    return F.aggregate(crossings, F.lit(0), lambda t, n: t + n) % 2 == 1


def albers(lon: Column, lat: Column, lon0: float, lat1: float, lat2: float, lat0: float) -> tuple[Column, Column]:
    """Equal-area conic projection of WGS84, in metres."""
    e2 = FLATTENING * (2 - FLATTENING)
    e = math.sqrt(e2)

    def q_of(s):
        log = F.log if isinstance(s, Column) else math.log
        return (1 - e2) * (s / (1 - e2 * s * s) - 1 / (2 * e) * log((1 - e * s) / (1 + e * s)))

    def m_of(lat: float) -> float:
        return math.cos(math.radians(lat)) / math.sqrt(1 - e2 * math.sin(math.radians(lat)) ** 2)

    m1, m2, q0, q1, q2 = m_of(lat1), m_of(lat2), *(q_of(math.sin(math.radians(v))) for v in (lat0, lat1, lat2))
    n = (m1 * m1 - m2 * m2) / (q2 - q1) if lat1 != lat2 else math.sin(math.radians(lat1))
    c = m1 * m1 + n * q1
    rho = SEMI_MAJOR * F.sqrt(c - n * q_of(F.sin(F.radians(lat)))) / n
    rho0 = SEMI_MAJOR * math.sqrt(c - n * q0) / n
    theta = n * F.radians(lon - lon0)
    return rho * F.sin(theta), rho0 - rho * F.cos(theta)


def box_gap(a: Column, b: Column) -> Column:
    """Distance between two ``bounds``."""
    apart = lambda k: F.greatest(F.lit(0.0), b[f"{k}0"] - a[f"{k}1"], a[f"{k}0"] - b[f"{k}1"])
    return F.hypot(apart("x"), apart("y"))


def box_union(a: Column, b: Column) -> Column:
    least, most = (lambda k: F.least(a[k], b[k]).alias(k)), (lambda k: F.greatest(a[k], b[k]).alias(k))
    return F.struct(least("x0"), least("y0"), most("x1"), most("y1"))


def _to_segment(p: Column, e: Column) -> Column:
    """Squared distance of a vertex from an edge."""
    dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
    long = dx * dx + dy * dy
    t = F.when(long > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((p["x"] - e["a"]["x"]) * dx + (p["y"] - e["a"]["y"]) * dy) / long))).otherwise(0.0)
    ox, oy = p["x"] - e["a"]["x"] - t * dx, p["y"] - e["a"]["y"] - t * dy
    return ox * ox + oy * oy


def _turn(a: Column, b: Column, c: Column) -> Column:
    return F.signum((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"]))


def edges_within(e: Column, f: Column, d: float) -> Column:
    """If two edges come as near as ``d``: they cross, or an end of one lies that near to the other."""
    cross = (_turn(e["a"], e["b"], f["a"]) * _turn(e["a"], e["b"], f["b"]) < 0) & (_turn(f["a"], f["b"], e["a"]) * _turn(f["a"], f["b"], e["b"]) < 0)
    near = F.least(_to_segment(e["a"], f), _to_segment(e["b"], f), _to_segment(f["a"], e), _to_segment(f["b"], e))
    return cross | (near <= d * d)


def inner_point(geom: Column) -> Column:
    """struct<x, y> inside the shape: the middle of the widest stretch of a part along the line halfway up it, between vertices."""
    def of_part(part: Column) -> Column:
        ys, box = F.transform(F.flatten(part), lambda p: p["y"]), bounds(F.array(part))
        mid = (box["y0"] + box["y1"]) / 2
        above, below = F.array_min(F.filter(ys, lambda y: y > mid)), F.array_max(F.filter(ys, lambda y: y <= mid))
        y = (F.coalesce(above, box["y1"]) + F.coalesce(below, box["y0"])) / 2
        at = lambda e: e["a"]["x"] + (y - e["a"]["y"]) * (e["b"]["x"] - e["a"]["x"]) / (e["b"]["y"] - e["a"]["y"])
        crossed = F.filter(F.flatten(F.transform(part, edges)), lambda e: (e["a"]["y"] > y) != (e["b"]["y"] > y))
        xs = F.array_sort(F.transform(crossed, at))
        spans = F.transform(F.filter(F.transform(xs, lambda x, i: F.struct(i.alias("i"), x.alias("lo"), F.get(xs, i + 1).alias("hi"))), lambda s: (s["i"] % 2 == 0) & s["hi"].isNotNull()), lambda s: F.struct((s["hi"] - s["lo"]).alias("w"), ((s["lo"] + s["hi"]) / 2).alias("x"), y.alias("y")))
        return F.array_max(spans)

    best = F.array_max(F.transform(geom, of_part))
    return F.struct(best["x"].alias("x"), best["y"].alias("y"))
