"""Clipping of shapes at a meridian."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import GEOMETRY, contains, let, signed_ring_area, without_repeats

RING = "array<struct<x:double,y:double>>"
Side = Callable[[Column], Column]


def _chains(ring: Column, at: Column, inside: Side) -> Column:
    """array<ring>: what of a ring lies inside, each from where it enters to where it leaves; nothing for a ring that doesn't cross."""
    n = F.size(ring)
    before = lambda i: F.get(ring, (i + n - 1) % n)
    here = F.sequence(F.lit(0), n - 1)

    def crossing(i: Column) -> Column:
        p, q = before(i % n), F.get(ring, i % n)
        return F.struct(at.alias("x"), (p["y"] + (at - p["x"]) * (q["y"] - p["y"]) / (q["x"] - p["x"])).alias("y"))

    def of(sides: Column) -> Column:
        """``sides``: for each vertex, if it lies inside."""
        was = lambda i: F.get(sides, (i + n - 1) % n)
        enters = F.filter(here, lambda i: F.get(sides, i) & ~was(i))
        leaves = F.filter(here, lambda i: ~F.get(sides, i) & was(i))
        return let(leaves, lambda out: F.transform(enters, lambda e: chain(e, out)))

    def chain(e: Column, leaves: Column) -> Column:
        later = F.get(F.filter(leaves, lambda x: x > e), F.lit(0))
        cut = lambda end: F.concat(F.array(crossing(e)), F.slice(F.concat(ring, ring), e + 1, end - e), F.array(crossing(end)))
        return let(F.coalesce(later, F.get(leaves, F.lit(0)) + n), cut)

    return let(F.transform(ring, inside), of)


def _joined(chains: Column) -> Column:
    """array<ring>: chains closed along the meridian. Of the places where chains end and where they begin, each sorted along it, equal
    ranks bound a stretch of the inside, since rings turn one way and holes the other; a fold joins what a stretch connects."""
    rank = lambda k: F.transform(F.array_sort(F.transform(chains, lambda c, i: F.struct(F.element_at(c, k)["y"].alias("y"), i.alias("i")))), lambda e: e["i"])
    links = F.arrays_zip(rank(-1).alias("f"), rank(1).alias("t"))
    piece = f"struct<first:int,last:int,pts:{RING}>"
    start = F.struct(F.transform(chains, lambda c, i: F.struct(i.alias("first"), i.alias("last"), c.alias("pts"))).cast(f"array<{piece}>").alias("open"), F.array().cast(f"array<{RING}>").alias("done"))

    def join(state: Column, link: Column) -> Column:
        a = F.get(F.filter(state["open"], lambda p: p["last"] == link["f"]), F.lit(0))
        b = F.get(F.filter(state["open"], lambda p: p["first"] == link["t"]), F.lit(0))
        return let(F.struct(a.alias("a"), b.alias("b")), lambda two: joined(state, two["a"], two["b"]))

    def joined(state: Column, a: Column, b: Column) -> Column:
        closed = a["first"] == b["first"]
        rest = F.filter(state["open"], lambda p: (p["first"] != a["first"]) & (p["first"] != b["first"]))
        both = F.struct(a["first"].alias("first"), b["last"].alias("last"), F.concat(a["pts"], b["pts"]).alias("pts"))
        return F.struct(
            F.when(closed, rest).otherwise(F.concat(rest, F.array(both))).cast(f"array<{piece}>").alias("open"),
            F.when(closed, F.concat(state["done"], F.array(a["pts"]))).otherwise(state["done"]).cast(f"array<{RING}>").alias("done"),
        )

    rings = F.transform(F.aggregate(links, start, join, lambda s: s["done"]), without_repeats)
    return F.filter(rings, lambda r: F.size(r) >= 3)


def _part(part: Column, at: Column, inside: Side) -> Column:
    """array<part>: what of one part lies inside."""
    whole = lambda r: F.forall(r, inside)

    def of(turned: Column) -> Column:
        cut = let(F.flatten(F.transform(turned, lambda r: _chains(r, at, inside))), _joined)
        outlines = F.concat(F.filter(F.slice(turned, 1, 1), whole), cut)
        holes = F.filter(F.slice(turned, 2, F.greatest(F.size(turned), F.lit(1))), whole)
        held = lambda o, holes: F.filter(holes, lambda h: contains(F.array(F.array(o)), h[0]["x"], h[0]["y"]))
        return let(holes, lambda hs: F.transform(outlines, lambda o: F.concat(F.array(o), held(o, hs))))

    return let(F.transform(part, lambda r, i: F.when((signed_ring_area(r) > 0) == (i == 0), r).otherwise(F.reverse(r))), of)


def clip_at(geom: Column, meridian: Column | float, west: bool) -> Column:
    """What of a shape lies west of a meridian, or on and east of it. A part can fall into several; holes that the meridian crosses become
    notches of the outline, others stay with the outline around them. Outlines come counter-clockwise. A shape wholly on the other side
    is an empty geometry, null stays null. Rings must not cross themselves or each other."""
    at = meridian if isinstance(meridian, Column) else F.lit(float(meridian))
    inside = (lambda p: p["x"] < at) if west else (lambda p: p["x"] >= at)
    return F.flatten(F.transform(geom, lambda p: _part(F.transform(p, without_repeats), at, inside))).cast(GEOMETRY)
