"""Spatial operators over shapes as arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clipping import clip_at
from ..functions.geometry import area, bounds, box_gap, box_union, contains, edges, edges_within, inner_point, part_area
from ..staging import stage
from .components import components
from .levels import meeting


def with_bounds(shapes: DataFrame) -> DataFrame:
    return shapes.withColumn("box", bounds(F.col("geom")))


def points_in_shapes(points: DataFrame, shapes: DataFrame, cell: float) -> DataFrame:
    """``points(x, y, ..)`` with the ``shape_id`` they lie in; points in none are left out.

    Both sides are dealt to square cells, a shape to each that its box touches: an equi-join on the cell, then the ray test. Cells
    about the size of a shape keep both the copies and the tests few.
    """
    def span(lo, hi):
        return F.sequence(F.floor(lo / cell).cast("int"), F.floor(hi / cell).cast("int"))

    boxed = with_bounds(shapes).select("shape_id", "geom", "box", F.explode(span(F.col("box.x0"), F.col("box.x1"))).alias("cx")).withColumn("cy", F.explode(span(F.col("box.y0"), F.col("box.y1"))))
    dealt = points.withColumn("cx", F.floor(F.col("x") / cell).cast("int")).withColumn("cy", F.floor(F.col("y") / cell).cast("int"))
    near = F.col("x").between(F.col("box.x0"), F.col("box.x1")) & F.col("y").between(F.col("box.y0"), F.col("box.y1"))
    return dealt.join(boxed, ["cx", "cy"]).where(near & contains(F.col("geom"), F.col("x"), F.col("y"))).drop("cx", "cy", "geom", "box")


def parts(shapes: DataFrame) -> DataFrame:
    """``(shape_id, part, ring0.., area, box)``: a row for each part, in order."""
    out = shapes.select("shape_id", F.posexplode("geom").alias("part", "rings"))
    return out.withColumn("area", part_area(F.col("rings"))).withColumn("box", bounds(F.array("rings")))


def thematic_projection(shapes: DataFrame) -> DataFrame:
    """One row ``(lon0, lat0, lat1, lat2)`` for an equal-area conic: the circular mean of the parts' longitudes, weighted by planar area;
    parallels at a sixth from either end of the latitudes, at least a degree of them."""
    p = parts(shapes).withColumn("lon", F.radians((F.col("box.x0") + F.col("box.x1")) / 2))
    s = p.agg(
        F.degrees(F.atan2(F.sum(F.col("area") * F.sin("lon")), F.sum(F.col("area") * F.cos("lon")))).alias("lon0"), F.min("box.y0").alias("lo"), F.max("box.y1").alias("hi")
    )
    mid, half = (F.col("lo") + F.col("hi")) / 2, F.greatest(F.col("hi") - F.col("lo"), F.lit(1.0)) / 2
    clamp = lambda c: F.least(F.greatest(c, F.lit(-89.0)), F.lit(89.0))
    return s.select("lon0", mid.alias("lat0"), clamp(mid - half * 2 / 3).alias("lat1"), clamp(mid + half * 2 / 3).alias("lat2"))


def main_parts(shapes: DataFrame, reach: float = 0.75, least: float = 0.35) -> DataFrame:
    """``(shape_id, n_parts, kept, share)``: ``kept`` lists the parts of the main landmass, ``share`` is their part of the area.

    From the largest part a hull, a box, takes in every part within ``reach`` times the root of the largest one's area, and grows with
    it, until none joins: a fragment can join through another. Where those hold under ``least`` of the area, all parts stay. The growth
    is a fold over each shape's own boxes, which stops working once a pass adds nothing.
    """
    one = F.transform("geom", lambda p, i: F.struct(part_area(p).alias("area"), (-i).alias("k"), bounds(F.array(p)).alias("box"), i.alias("i")))
    s = shapes.select("shape_id", one.alias("ps")).withColumn("top", F.array_max("ps")).withColumn("reach", reach * F.sqrt("top.area"))
    grown = lambda hull: F.aggregate("ps", hull, lambda h, p: F.when(box_gap(p["box"], h) <= F.col("reach"), box_union(h, p["box"])).otherwise(h))

    def one_pass(state: Column, k: Column) -> Column:
        after = grown(state["hull"])
        return F.when(state["done"], state).otherwise(F.struct(after.alias("hull"), (after == state["hull"]).alias("done")))

    start = F.struct(box_union(F.col("top.box"), F.col("top.box")).alias("hull"), F.lit(False).alias("done"))
    s = s.withColumn("hull", F.aggregate(F.sequence(F.lit(1), F.size("ps")), start, one_pass, lambda a: a["hull"]))
    s = s.withColumn("near", F.filter("ps", lambda p: box_gap(p["box"], F.col("hull")) <= F.col("reach")))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda t, p: t + p["area"])
    s = s.withColumn("share", F.coalesce(F.try_divide(total("near"), total("ps")), F.lit(1.0)))
    everything = F.col("share") < least
    kept = F.transform(F.when(everything, F.col("ps")).otherwise(F.col("near")), lambda p: p["i"])
    return s.select("shape_id", F.size("ps").alias("n_parts"), F.array_sort(kept).alias("kept"), F.when(everything, 1.0).otherwise(F.col("share")).alias("share"))


#: Strips that `_held` cuts a part's height into.
STRIPS = 1024


def _held(p: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """``(u, v)``: parts of ``p(id, box, first)`` of which one holds the other's first vertex. Boxes are met by levels; a ray from the vertex
    then crosses the edges in its strip of the other's height, an odd number of times, so outlines are never copied to candidates."""
    strip = lambda y: F.floor((y - F.col("a_box.y0")) / (F.col("a_box.y1") - F.col("a_box.y0")) * STRIPS).cast("int")
    a = p.select(F.col("id").alias("a_id"), F.col("box").alias("a_box"))
    v = F.col("first")
    b = p.select(F.col("id").alias("b_id"), F.struct(v["x"].alias("x0"), v["y"].alias("y0"), v["x"].alias("x1"), v["y"].alias("y1")).alias("b_box"))
    tall = F.col("a_box.y1") > F.col("a_box.y0")
    asked = meeting(a, b, (F.col("a_id") != F.col("b_id")) & tall).select("a_id", "b_id", F.col("b_box.x0").alias("x"), F.col("b_box.y0").alias("y"), strip(F.col("b_box.y0")).alias("strip"))
    low, high = F.least("e.a.y", "e.b.y"), F.greatest("e.a.y", "e.b.y")
    rows = edge_rows.select(F.col("id").alias("a_id"), "e").join(a, "a_id").where(tall & (low < high)).select("a_id", "e", F.explode(F.sequence(strip(low), strip(high))).alias("strip"))
    p_, q = F.col("e.a"), F.col("e.b")
    at = p_["x"] + (F.col("y") - p_["y"]) * (q["x"] - p_["x"]) / (q["y"] - p_["y"])
    crossed = asked.join(rows, ["a_id", "strip"]).where(((p_["y"] > F.col("y")) != (q["y"] > F.col("y"))) & (F.col("x") < at))
    return crossed.groupBy("a_id", "b_id").agg(F.count("*").alias("n")).where("n % 2 = 1").select(F.col("a_id").alias("u"), F.col("b_id").alias("v"))


def land_masses(shapes: DataFrame, within: float) -> DataFrame:
    """``(mass, n_parts, area, x0, y0, x1, y1)`` of parts joined where their outlines come within ``within`` of each other, or one holds the
    other; ``mass`` is the first of its parts, as ``shape_id:part``.

    Edges of outlines meet through an index of levels, each in cells of its own size: what is compared grows with the edges and how
    densely they lie, however large a mainland is beside its islets, and no outline is copied. Masses are the connected components,
    by contraction.
    """
    p = stage(parts(shapes).withColumn("name", F.concat_ws(":", "shape_id", "part")).withColumn("id", F.xxhash64("shape_id", "part")), "land-parts")
    edge_rows = p.select("id", F.explode(edges(F.col("rings")[0])).alias("e"))
    half = within / 2
    grown = lambda e: F.struct(*((f(e["a"][k], e["b"][k]) + d).alias(f"{k}{i}") for i, f, d in (("0", F.least, -half), ("1", F.greatest, half)) for k in "xy"))
    sides = [edge_rows.select(F.col("id").alias(f"{s}_id"), F.col("e").alias(f"{s}_e"), grown(F.col("e")).alias(f"{s}_box")) for s in "ab"]
    near = meeting(*sides, (F.col("a_id") < F.col("b_id")) & edges_within(F.col("a_e"), F.col("b_e"), within)).select(F.col("a_id").alias("u"), F.col("b_id").alias("v"))
    roots = components(near.union(_held(p.select("id", "box", F.col("rings")[0][0].alias("first")), edge_rows)))
    out = p.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    first = F.min_by("name", F.struct("shape_id", "part"))
    return out.groupBy("root").agg(
        first.alias("mass"), F.count("*").alias("n_parts"), F.sum("area").alias("area"), F.min("box.x0").alias("x0"), F.min("box.y0").alias("y0"), F.max("box.x1").alias("x1"), F.max("box.y1").alias("y1")
    ).drop("root")


def land_report(masses: DataFrame) -> DataFrame:
    """One row ``(mass_count, main_area_share, main_width_share)`` of `land_masses`: how much of the land and of the frame's width the
    largest mass has."""
    main = F.max(F.struct("area", (F.col("x1") - F.col("x0")).alias("width")))
    s = masses.agg(F.count("*").alias("mass_count"), main.alias("main"), F.sum("area").alias("total"), (F.max("x1") - F.min("x0")).alias("span"))
    return s.select("mass_count", F.coalesce(F.try_divide("main.area", "total"), F.lit(1.0)).alias("main_area_share"), F.coalesce(F.try_divide("main.width", "span"), F.lit(1.0)).alias("main_width_share"))


def total_bounds(shapes: DataFrame) -> DataFrame:
    """One row ``(x0, y0, x1, y1, aspect)`` of all shapes; aspect is width over height, 1 where either is nothing."""
    box = with_bounds(shapes).agg(F.min("box.x0").alias("x0"), F.min("box.y0").alias("y0"), F.max("box.x1").alias("x1"), F.max("box.y1").alias("y1"))
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return box.withColumn("aspect", F.when((w > 0) & (h > 0), w / h).otherwise(1.0))


def inner_points(shapes: DataFrame) -> DataFrame:
    """``(shape_id, x, y)``: a point inside each shape, where its label or circle stands."""
    return shapes.select("shape_id", inner_point(F.col("geom")).alias("p")).select("shape_id", "p.*")


# Meridians east of which a country's land goes to an inset; the inset's height and margin; least gain in width.
DECLARED_INSETS = {"vietnam": 111.0, "viet nam": 111.0, "việt nam": 111.0}
INSET_HEIGHT, INSET_MARGIN, INSET_GAIN = 0.30, 0.045, 0.15


def declared_inset(country: str | None, by_hand: dict | None = None) -> tuple[float | None, str]:
    """(meridian, source) of a country: what the profile's ``inset_meridian`` says, null included, else the built-in table. Raises
    ValueError where the profile says something else than a longitude."""
    if by_hand and "inset_meridian" in by_hand:
        lon = by_hand["inset_meridian"]
        if lon is None:
            return None, "declared_as_none"
        if isinstance(lon, bool) or not isinstance(lon, int | float) or not -180 <= lon <= 180:
            raise ValueError(f"inset_meridian must be a longitude or null, not {lon!r}")
        return float(lon), "declared_by_user"
    name = " ".join((country or "").lower().replace("-", " ").replace("_", " ").split())
    return (DECLARED_INSETS[name], "built_in") if name in DECLARED_INSETS else (None, "undeclared")


def split_at(shapes: DataFrame, meridian: float) -> DataFrame:
    """``shapes`` with ``west`` and ``east``: what of each lies on either side of a meridian, longitudes being the x of ``geom``; every other
    column, ``geom`` too, is untouched, and so is the order of rows. Project after splitting: a meridian is no straight line then."""
    return shapes.withColumns({"west": clip_at(F.col("geom"), meridian, True), "east": clip_at(F.col("geom"), meridian, False)})


def clip_for_drawing(shapes: DataFrame, plan: DataFrame, meridian: float | None) -> DataFrame:
    """``shapes`` with ``drawn``, the geometry to draw on the main map: where ``plan``, of `inset_view`, has its row, what lies west of the
    meridian, else all of it. Rows, their order and ``geom``, from which labels and values come, stay as they are."""
    if meridian is None or plan.isEmpty():
        return shapes.withColumn("drawn", F.col("geom"))
    return shapes.withColumn("drawn", clip_at(F.col("geom"), meridian, True))


def inset_view(shapes: DataFrame, meridian: float | None) -> DataFrame:
    """One row with the bounds of the view, of the inset's box in it and of what the inset shows, and ``scale``; no row where the map is
    framed the ordinary way: no meridian, land on one side of it only, or a gain in width under INSET_GAIN of the mainland's.

    Bounds are those of the land on either side, clipped at the meridian; longitudes are the x of ``shapes``.
    """
    sides = split_at(shapes.select("geom"), 0.0 if meridian is None else meridian)
    ends = lambda side, name: [f(F.col(f"{side}.{c}")).alias(f"{name}_{c}") for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))]
    b = sides.select(bounds(F.col("west")).alias("west"), bounds(F.col("east")).alias("east")).agg(*ends("west", "main"), *ends("east", "far"))
    w, h = F.col("main_x1") - F.col("main_x0"), F.col("main_y1") - F.col("main_y0")
    far_w, far_h = F.col("far_x1") - F.col("far_x0"), F.col("far_y1") - F.col("far_y0")
    b = b.where(F.lit(meridian is not None) & F.col("main_x0").isNotNull() & F.col("far_x0").isNotNull()).where(F.col("far_x1") - F.col("main_x1") >= w * INSET_GAIN)
    b = b.withColumn("box_h", h * INSET_HEIGHT).withColumn("box_w", F.when(far_h > 0, h * INSET_HEIGHT * far_w / far_h).otherwise(h * INSET_HEIGHT))
    right = F.col("main_x1") + 2 * w * INSET_MARGIN + F.col("box_w")
    return b.select(
        F.col("main_x0").alias("view_x0"), F.col("main_y0").alias("view_y0"), right.alias("view_x1"), F.col("main_y1").alias("view_y1"), (right - w * INSET_MARGIN - F.col("box_w")).alias("inset_x0"), (F.col("main_y0") + w * INSET_MARGIN).alias("inset_y0"),
        "box_w", "box_h", "far_x0", "far_y0", "far_x1", "far_y1", F.try_divide("box_w", far_w).alias("scale"), (w / (right - F.col("main_x0")) * 100).alias("mainland_width_pct"),
    )


def outline(shapes: DataFrame) -> DataFrame:
    """``(x0, y0, x1, y1)``: the edges that only one ring has, which is the outer border of shapes that share their borders exactly."""
    ring = F.explode(F.flatten("geom")).alias("ring")
    e = shapes.select(ring).select(F.explode(F.transform(F.col("ring"), lambda p, i: F.struct(p.alias("a"), F.get(F.col("ring"), (i + 1) % F.size("ring")).alias("b")))).alias("e"))
    one = e.select(F.least("e.a", "e.b").alias("a"), F.greatest("e.a", "e.b").alias("b")).where("a <> b")
    return one.groupBy("a", "b").count().where("count = 1").select(F.col("a.x").alias("x0"), F.col("a.y").alias("y0"), F.col("b.x").alias("x1"), F.col("b.y").alias("y1"))


def shape_facts(shapes: DataFrame, attributes: dict[str, str] | None = None) -> DataFrame:
    """``(shape_id, area, population, density)`` of each unit, from the columns that ``attributes`` names for them; what it doesn't name
    is null, but for the area, which is then the shape's own in the square of its units."""
    told = attributes or {}
    named = lambda key: F.col(told[key]).try_cast("double") if key in told else F.lit(None).cast("double")
    own = named("area") if "area" in told else area(F.col("geom"))
    people = named("population")
    density = named("density") if "density" in told else F.try_divide(people, own)
    return shapes.select("shape_id", own.alias("area"), people.alias("population"), density.alias("density"))
