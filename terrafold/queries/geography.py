"""A grid of unit squares, one for each nation, and points of customers."""

from pyspark.sql import functions as F

from ..functions.geometry import albers, area
from ..operators import geo
from ..operators.topology import coverage_simplify
from ..sources import folders as fo
from ..sources.shapefile import layer_units, read_shapefiles, write_shapefiles
from ..staging import new_path, spread, stage
from .registry import query

X, Y = "(n_nationkey % 5)", "(n_nationkey // 5)"
POINT = "SELECT c_custkey, (c_custkey * 7919 % 5003) / 1000.0 AS x, (c_custkey * 104729 % 5009) / 1000.0 AS y FROM customer"


def squares(load):
    x, y = (F.col("n_nationkey") % 5).cast("double"), F.floor(F.col("n_nationkey") / 5).cast("double")
    corner = lambda i, j: F.struct((x + i).alias("x"), (y + j).alias("y"))
    ring = F.array(corner(0.0, 0.0), corner(1.0, 0.0), corner(1.0, 1.0), corner(0.0, 1.0))
    return load("nation").select(F.col("n_nationkey").alias("shape_id"), "n_regionkey", F.array(F.array(ring)).alias("geom"))


def points(load):
    return load("customer").select("c_custkey", (F.col("c_custkey") * 7919 % 5003 / 1000.0).alias("x"), (F.col("c_custkey") * 104729 % 5009 / 1000.0).alias("y"))


@query("geo_area", "SELECT n_nationkey AS shape_id, 1.0::DOUBLE AS area FROM nation")
def geo_area(load, spark):
    return squares(load).select("shape_id", F.round(area(F.col("geom")), 9).alias("area"))


@query("geo_bbox", f"SELECT n_nationkey AS shape_id, {X}::DOUBLE AS x0, {Y}::DOUBLE AS y0, ({X} + 1)::DOUBLE AS x1, ({Y} + 1)::DOUBLE AS y1 FROM nation")
def geo_bbox(load, spark):
    return geo.with_bounds(squares(load)).select("shape_id", "box.*")


@query("geo_point_in_polygon", f"SELECT (floor(y) * 5 + floor(x))::INT AS shape_id, count(*) AS points FROM ({POINT}) WHERE x < 5 AND y < 5 GROUP BY 1")
def geo_point_in_polygon(load, spark):
    return geo.points_in_shapes(points(load), squares(load), 1.0).groupBy("shape_id").agg(F.count("*").alias("points"))


@query("geo_circular_mean_lon", "SELECT 2.5::DOUBLE AS lon0, 2.5::DOUBLE AS lat0, round(2.5 - 5.0 / 3, 6) AS lat1, round(2.5 + 5.0 / 3, 6) AS lat2")
def geo_circular_mean_lon(load, spark):
    return geo.thematic_projection(squares(load)).select(*(F.round(c, 6).alias(c) for c in ("lon0", "lat0", "lat1", "lat2")))


def albers_sql(lon0: float, lat1: float, lat2: float, lat0: float) -> str:
    e2 = "(1 / 298.257223563 * (2 - 1 / 298.257223563))"
    q = lambda s: f"((1 - {e2}) * ({s} / (1 - {e2} * {s} * {s}) - 1 / (2 * sqrt({e2})) * ln((1 - sqrt({e2}) * {s}) / (1 + sqrt({e2}) * {s}))))"
    m = lambda a: f"(cos(radians({a})) / sqrt(1 - {e2} * pow(sin(radians({a})), 2)))"
    return f"""WITH p AS ({POINT}), k AS (SELECT (pow({m(lat1)}, 2) - pow({m(lat2)}, 2)) / ({q(f'sin(radians({lat2}))')} - {q(f'sin(radians({lat1}))')}) AS n),
c AS (SELECT n, pow({m(lat1)}, 2) + n * {q(f'sin(radians({lat1}))')} AS c FROM k),
r AS (SELECT c_custkey, n, 6378137.0 * sqrt(c - n * {q('sin(radians(y + 10))')}) / n AS rho, 6378137.0 * sqrt(c - n * {q(f'sin(radians({lat0}))')}) / n AS rho0, n * radians(x + 100 - {lon0}) AS theta FROM p, c)
SELECT c_custkey, round(rho * sin(theta), 3) AS px, round(rho0 - rho * cos(theta), 3) AS py FROM r"""


@query("geo_albers", albers_sql(102.5, 11.0, 14.0, 12.5))
def geo_albers(load, spark):
    px, py = albers(F.col("x") + 100, F.col("y") + 10, 102.5, 11.0, 14.0, 12.5)
    return points(load).select("c_custkey", F.round(px, 3).alias("px"), F.round(py, 3).alias("py"))


@query("geo_outline", f"""WITH e AS (SELECT * FROM (SELECT {X} AS i, {Y} AS j FROM nation), (VALUES (0, 0, 1, 0), (1, 0, 1, 1), (0, 1, 1, 1), (0, 0, 0, 1)) t(a, b, c, d))
SELECT (i + a)::DOUBLE AS x0, (j + b)::DOUBLE AS y0, (i + c)::DOUBLE AS x1, (j + d)::DOUBLE AS y1 FROM e GROUP BY ALL HAVING count(*) = 1""")  # fmt: skip
def geo_outline(load, spark):
    return geo.outline(squares(load))


def shifted(load):
    """Rows 3 and 4 of the grid lie two units apart from the others; one square of row 0 is an L around its neighbour's corner."""
    move = F.when(F.col("shape_id") >= 15, 2.0).otherwise(0.0)
    return squares(load).withColumn("geom", F.transform("geom", lambda p: F.transform(p, lambda r: F.transform(r, lambda v: F.struct(v["x"].alias("x"), (v["y"] + move).alias("y"))))))


@query("geo_land_masses", "SELECT '0:0' AS mass, 15::BIGINT AS n_parts, count(*) FILTER (n_nationkey < 15)::DOUBLE AS area, 5.0::DOUBLE AS width FROM nation UNION ALL SELECT '15:0', 10, count(*) FILTER (n_nationkey >= 15), 5.0 FROM nation")
def geo_land_masses(load, spark):
    out = geo.land_masses(shifted(load), 0.5)
    return out.select("mass", "n_parts", F.round("area", 6).alias("area"), F.round(F.col("x1") - F.col("x0"), 6).alias("width"))


FAR = "CASE WHEN n_regionkey = 2 THEN 12.0 ELSE 0.0 END"


def far_region(load):
    """The squares of region 2 lie twelve units to the east."""
    move = F.when(F.col("n_regionkey") == 2, 12.0).otherwise(0.0)
    return squares(load).withColumn("geom", F.transform("geom", lambda p: F.transform(p, lambda r: F.transform(r, lambda v: F.struct((v["x"] + move).alias("x"), v["y"].alias("y"))))))


# Squares touch along edges and at corners; the components of each side are found by spreading labels eight ways.
MASSES = f"""WITH RECURSIVE s AS (SELECT n_nationkey AS k, {X} + {FAR} AS x, {Y} AS y FROM nation),
r AS (SELECT k, k AS m, x, y, 0 AS d FROM s UNION SELECT s.k, r.m, s.x, s.y, 0 FROM r JOIN s ON abs(s.x - r.x) <= 1 AND abs(s.y - r.y) <= 1),
m AS (SELECT k, min(m) AS mass, any_value(x) AS x, any_value(y) AS y FROM r GROUP BY k),
g AS (SELECT mass, count(*)::DOUBLE AS area, max(x) + 1 - min(x) AS width FROM m GROUP BY mass)"""


@query("geo_land_report", f"{MASSES} SELECT count(*) AS mass_count, round(max(area) / sum(area), 6) AS main_area_share, round(arg_max(width, (area, width)) / (SELECT max(x) + 1 - min(x) FROM s), 6)::DOUBLE AS main_width_share FROM g")
def geo_land_report(load, spark):
    out = geo.land_report(geo.land_masses(far_region(load), 0.1))
    return out.select("mass_count", F.round("main_area_share", 6).alias("main_area_share"), F.round("main_width_share", 6).alias("main_width_share"))


# A shape for each region; its squares but the first, which is three units wide, reach it by chains of gaps of up to 0.75 units.
HULL = """WITH RECURSIVE p AS (SELECT n_regionkey AS shape_id, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INT AS i, n_nationkey AS k FROM nation),
b AS (SELECT shape_id, i, CASE WHEN i = 0 THEN 0.0 ELSE 3.0 + (i - 1) * 1.5 + CASE WHEN k % 3 = 0 AND i > 2 THEN 40.0 ELSE 0.5 END END AS x0, CASE WHEN i = 0 THEN 3.0 ELSE 3.0 + (i - 1) * 1.5 + CASE WHEN k % 3 = 0 AND i > 2 THEN 40.0 ELSE 0.5 END + 1 END AS x1, CASE WHEN i = 0 THEN 3.0 ELSE 1.0 END AS area FROM p),
h AS (SELECT shape_id, 3.0::DOUBLE AS hi, 0 AS step FROM b WHERE i = 0 UNION ALL SELECT h.shape_id, (SELECT max(x1) FROM b WHERE b.shape_id = h.shape_id AND b.x0 - h.hi <= 0.75 * sqrt(3.0))::DOUBLE, step + 1 FROM h WHERE step < 30),
e AS (SELECT shape_id, max(hi) AS hi FROM h GROUP BY 1)"""


def archipelagos(load):
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1
    n = load("nation").select("n_regionkey", i.alias("i"), "n_nationkey")
    x0 = F.when(F.col("i") == 0, 0.0).otherwise(3.0 + (F.col("i") - 1) * 1.5 + F.when((F.col("n_nationkey") % 3 == 0) & (F.col("i") > 2), 40.0).otherwise(0.5))
    x1 = F.when(F.col("i") == 0, 3.0).otherwise(x0 + 1)
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), F.lit(y).alias("y"))
    ring = F.array(corner(x0, 0.0), corner(x1, 0.0), corner(x1, 1.0), corner(x0, 1.0))
    parts = n.select("n_regionkey", F.struct("i", F.array(ring).alias("part")).alias("p")).groupBy(F.col("n_regionkey").alias("shape_id"))
    return parts.agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["part"]).alias("geom"))


@query("geo_main_landmass", f"""{HULL} SELECT shape_id, count(*)::INT AS n_parts, array_to_string(list_sort(list(i) FILTER (x0 - hi <= 0.75 * sqrt(3.0))), ',') AS kept, round(sum(area) FILTER (x0 - hi <= 0.75 * sqrt(3.0)) / sum(area), 6) AS share FROM b JOIN e USING (shape_id) GROUP BY shape_id""")
def geo_main_landmass(load, spark):
    return geo.main_parts(archipelagos(load)).select("shape_id", "n_parts", F.array_join("kept", ",").alias("kept"), F.round("share", 6).alias("share"))


@query("geo_inner_point", f"SELECT n_nationkey AS shape_id, ({X} + 0.5)::DOUBLE AS x, ({Y} + 0.5)::DOUBLE AS y FROM nation")
def geo_inner_point(load, spark):
    return geo.inner_points(squares(load))


@query("geo_total_bounds", f"SELECT min({X})::DOUBLE AS x0, min({Y})::DOUBLE AS y0, max({X} + 1)::DOUBLE AS x1, max({Y} + 1)::DOUBLE AS y1, ((max({X} + 1) - min({X}))::DOUBLE / (max({Y} + 1) - min({Y}))) AS aspect FROM nation WHERE n_regionkey < 3")
def geo_total_bounds(load, spark):
    return geo.total_bounds(squares(load).where("n_regionkey < 3"))


@query("geo_inset_view", f"""WITH s AS (SELECT {X} + {FAR} AS x, {Y} AS y, {X} + {FAR} + 0.5 < 10 AS main FROM nation),
b AS (SELECT min(x) FILTER (main) AS a0, min(y) FILTER (main) AS b0, max(x + 1) FILTER (main) AS a1, max(y + 1) FILTER (main) AS b1, min(x) FILTER (NOT main) AS c0, min(y) FILTER (NOT main) AS d0, max(x + 1) FILTER (NOT main) AS c1, max(y + 1) FILTER (NOT main) AS d1 FROM s),
v AS (SELECT *, (b1 - b0) * 0.3 AS bh, (b1 - b0) * 0.3 * (c1 - c0) / (d1 - d0) AS bw FROM b)
SELECT round(a0, 6)::DOUBLE AS view_x0, round(a1 + 0.09 * (a1 - a0) + bw, 6)::DOUBLE AS view_x1, round(a1 + 0.045 * (a1 - a0), 6)::DOUBLE AS inset_x0, round(b0 + 0.045 * (a1 - a0), 6)::DOUBLE AS inset_y0, round(bw, 6)::DOUBLE AS box_w, round(bh, 6)::DOUBLE AS box_h, round(bw / (c1 - c0), 6)::DOUBLE AS scale FROM v""")  # fmt: skip
def geo_inset_view(load, spark):
    out = geo.inset_view(far_region(load), 10.0)
    return out.select(*(F.round(c, 6).alias(c) for c in ("view_x0", "view_x1", "inset_x0", "inset_y0", "box_w", "box_h", "scale")))


@query("geo_unit_facts", "SELECT n_nationkey AS shape_id, 1.0::DOUBLE AS area, (n_nationkey * 1000)::DOUBLE AS population, (n_nationkey * 1000)::DOUBLE AS density FROM nation")
def geo_unit_facts(load, spark):
    shapes = squares(load).withColumn("dan_so", (F.col("shape_id") * 1000).cast("string"))
    return geo.shape_facts(shapes, {"population": "dan_so"}).withColumn("area", F.round("area", 9)).withColumn("density", F.round("density", 6))


# A lattice of cells, one for each customer; each border has a tip in its middle, of a height that its place gives, and small teeth.
WIDE, TOLERANCE = 40, 0.245
ACROSS, UP = "((({i}) * 7 + ({j}) * 13) % 11 - 5) / 20.0", "((({i}) * 5 + ({j}) * 17) % 7 - 3) / 15.0"


def jagged(load):
    i, j = F.col("c_custkey") % WIDE, F.floor(F.col("c_custkey") / WIDE)
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    def across(i, j):
        d = ((i * 7 + j * 13) % 11 - 5) / 20.0
        return [point(i, j), point(i + 0.25, j + d / 2 + 0.001), point(i + 0.5, j + d), point(i + 0.75, j + d / 2 + 0.001)], point(i + 1, j)

    def up(i, j):
        d = ((i * 5 + j * 17) % 7 - 3) / 15.0
        return [point(i, j), point(i + d / 2 + 0.001, j + 0.25), point(i + d, j + 0.5), point(i + d / 2 + 0.001, j + 0.75)], point(i, j + 1)

    ahead = lambda line: line[0]
    back = lambda line: [line[1], *line[0][:0:-1]]
    ring = F.array(*ahead(across(i, j)), *ahead(up(i + 1, j)), *back(across(i, j + 1)), *back(up(i, j)))
    return spread(load("customer").select("c_custkey")).select(F.col("c_custkey").alias("shape_id"), F.array(F.array(ring)).alias("geom"))


# A tip stays if its triangle, half its height, is not below the squared tolerance.
TIPS = f"""WITH c AS (SELECT c_custkey AS shape_id, c_custkey % {WIDE} AS i, c_custkey // {WIDE} AS j FROM customer),
d AS (SELECT *, {ACROSS.format(i="i", j="j")} AS s, {UP.format(i="i + 1", j="j")} AS e, {ACROSS.format(i="i", j="j + 1")} AS n, {UP.format(i="i", j="j")} AS w FROM c),
t AS (SELECT shape_id, i, j, {", ".join(f"CASE WHEN abs({k}) / 2 >= {TOLERANCE**2} THEN {k} ELSE 0 END AS {k}" for k in "senw")} FROM d)"""


@query("geo_simplify", f"{TIPS} SELECT shape_id, round(1 + (n - s + e - w) / 2, 6)::DOUBLE AS area, 4 + (s <> 0)::INT + (e <> 0)::INT + (n <> 0)::INT + (w <> 0)::INT AS vertices FROM t")
def geo_simplify(load, spark):
    out = coverage_simplify(jagged(load), TOLERANCE)
    return out.select("shape_id", F.round(area(F.col("geom")), 6).alias("area"), F.size(F.col("geom")[0][0]).alias("vertices"))


@query("geo_simplify_outline", f"""{TIPS},
e AS (SELECT unnest([{{'k': 'a', 'x': i, 'y': j, 'd': s}}, {{'k': 'u', 'x': i + 1, 'y': j, 'd': e}}, {{'k': 'a', 'x': i, 'y': j + 1, 'd': n}}, {{'k': 'u', 'x': i, 'y': j, 'd': w}}], recursive := true) FROM t),
o AS (SELECT k, x, y, any_value(d) AS d FROM e GROUP BY k, x, y HAVING count(*) = 1)
SELECT sum(CASE WHEN d = 0 THEN 1 ELSE 2 END)::BIGINT AS edges, round(sum(2 * sqrt(0.25 + d * d)), 6)::DOUBLE AS length FROM o""")  # fmt: skip
def geo_simplify_outline(load, spark):
    """The border of all thinned cells together: no edge of an inner border is left over."""
    out = geo.outline(coverage_simplify(jagged(load), TOLERANCE))
    return out.agg(F.count("*").alias("edges"), F.round(F.sum(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))), 6).alias("length"))


# A block for each customer, open to the east like a C, with a hole; the meridian is anywhere in it.
MERIDIAN, WEST_END = 7.25, "(c_custkey * 37 % 101) / 10.0"


def blocks(load):
    x0 = F.col("c_custkey") * 37 % 101 / 10.0
    ring = lambda *ends: F.array(*(F.struct((x0 + x).alias("x"), F.lit(float(y)).alias("y")) for x, y in ends))
    outer = ring((0, 0), (4, 0), (4, 1), (2, 1), (2, 2), (4, 2), (4, 3), (0, 3))
    hole = ring((0.5, 0.25), (0.5, 0.75), (1.5, 0.75), (1.5, 0.25))
    return spread(load("customer").select("c_custkey")).select(F.col("c_custkey").alias("shape_id"), F.array(F.array(outer, hole)).alias("geom"))


CUT = f"WITH t AS (SELECT c_custkey AS shape_id, greatest(0, least(4, {MERIDIAN} - {WEST_END})) AS t FROM customer), w AS (SELECT *, t * 3 - greatest(0, t - 2) - greatest(0, least(1, t - 0.5)) / 2 AS west FROM t)"


@query("geo_split_meridian", f"{CUT} SELECT shape_id, round(west, 6)::DOUBLE AS west, round(9.5 - west, 6)::DOUBLE AS east, (t > 0)::INT AS west_parts, CASE WHEN t >= 4 THEN 0 WHEN t > 2 THEN 2 ELSE 1 END AS east_parts, 9.5::DOUBLE AS whole FROM w")
def geo_split_meridian(load, spark):
    out = geo.split_at(blocks(load), MERIDIAN)
    return out.select("shape_id", F.round(area(F.col("west")), 6).alias("west"), F.round(area(F.col("east")), 6).alias("east"), F.size("west").alias("west_parts"), F.size("east").alias("east_parts"), F.round(area(F.col("geom")), 6).alias("whole"))


@query("geo_clip_for_drawing", f"{CUT} SELECT shape_id, round(west, 6)::DOUBLE AS drawn, 9.5::DOUBLE AS whole FROM w")
def geo_clip_for_drawing(load, spark):
    shapes = blocks(load)
    out = geo.clip_for_drawing(shapes, geo.inset_view(shapes, MERIDIAN), MERIDIAN)
    return out.select("shape_id", F.round(area(F.col("drawn")), 6).alias("drawn"), F.round(area(F.col("geom")), 6).alias("whole"))


@query("source_shapefile", "SELECT c_custkey AS id, c_name AS name, 9.5::DOUBLE AS area, 2 AS rings FROM customer")
def source_shapefile(load, spark):
    """Written as a layer, a file for each partition, and read back in ranges of records."""
    folder = new_path(spark, "layer")
    named = blocks(load).join(load("customer").select(F.col("c_custkey").alias("shape_id"), "c_name"), "shape_id")
    stage(write_shapefiles(named, folder, ["shape_id", "c_name"]), "layer-files")
    back = read_shapefiles(spark, folder, range_bytes=1 << 18)
    return back.select(F.col("properties")["shape_id"].cast("bigint").alias("id"), F.col("properties")["c_name"].alias("name"), F.round(area(F.col("geom")), 6).alias("area"), F.size(F.col("geom")[0]).alias("rings"))


@query("source_layer_units", "SELECT 'units' AS tier, count(*) AS units FROM customer")
def source_layer_units(load, spark):
    """Features of a written layer, counted from its index alone."""
    folder = new_path(spark, "layer")
    stage(write_shapefiles(blocks(load), folder, ["shape_id"]), "layer-files")
    return layer_units(spark, {"units": folder})


def country_folder(load, spark):
    """A country of three layers: customers as communes, nations as provinces, and an outline."""
    root = new_path(spark, "boundaries")
    outline = squares(load).where("n_regionkey = 0 AND shape_id = 0").select(F.lit("XYZ").alias("GID_0"), F.lit("Land").alias("COUNTRY"), "geom")
    for tier, shapes, columns in (("communes", blocks(load), ["shape_id"]), ("provinces", squares(load), ["shape_id", "n_regionkey"]), ("outline", outline, ["GID_0", "COUNTRY"])):
        stage(write_shapefiles(shapes.coalesce(1), f"{root}/land/{tier}", columns), "layer-files")
    return fo.layer_listing(spark, root)


@query("source_country_tiers", "SELECT 'land' AS country, * FROM (VALUES ('communes', (SELECT count(*) FROM customer), 'commune'), ('provinces', (SELECT count(*) FROM nation), 'province'), ('outline', (SELECT count(*) FROM nation WHERE n_nationkey = 0), NULL)) t(tier, units, role)")
def source_country_tiers(load, spark):
    """Roles of the tiers of the one country in a folder, by their units; the outline is known by its columns."""
    listing = country_folder(load, spark)
    country = fo.resolve_country(listing)
    return fo.country_tiers(spark, listing, country).select(F.lit(country).alias("country"), "tier", "units", "role")


@query("source_resolved_tier", "SELECT n_nationkey::BIGINT AS id, n_regionkey::BIGINT AS region, 1.0::DOUBLE AS area FROM nation")
def source_resolved_tier(load, spark):
    """The coarse tier, asked for by its role."""
    listing = country_folder(load, spark)
    found = fo.resolve_tier(fo.country_tiers(spark, listing, fo.resolve_country(listing)), "province")
    p = F.col("properties")
    return fo.read_layer(spark, found["path"]).select(p["shape_id"].cast("bigint").alias("id"), p["n_regionke"].cast("bigint").alias("region"), F.round(area(F.col("geom")), 6).alias("area"))
