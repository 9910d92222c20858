"""Boundary layers: GeoJSON to shapes, the scheme their columns follow, tiers by how many units they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import GEOMETRY, without_repeats
from ..functions.text import demojibake

POINT = "array<double>"


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """``(shape_id, properties map<string,string>, geom)`` of the features of GeoJSON files: ids count from 0 in the order of the features.

    A file is one JSON document, so one task reads it; polygons and multipolygons, others have a null shape; the closing vertex of a ring,
    which repeats the first, goes.
    """
    schema = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
    docs = spark.read.schema(schema).json(path, multiLine=True)
    f = docs.select(F.col("_metadata.file_path").alias("path"), F.posexplode("features").alias("i", "f"))
    polygon = F.from_json("f.geometry.coordinates", f"array<array<{POINT}>>")
    many = F.from_json("f.geometry.coordinates", f"array<array<array<{POINT}>>>")
    raw = F.when(F.col("f.geometry.type") == "Polygon", F.array(polygon)).when(F.col("f.geometry.type") == "MultiPolygon", many)
    vertex = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    open_ring = lambda r: F.slice(r, F.lit(1), F.when((F.size(r) > 1) & (F.element_at(r, -1) == r[0]), F.size(r) - 1).otherwise(F.size(r)))
    geom = F.transform(raw, lambda part: F.transform(part, lambda ring: F.transform(open_ring(ring), vertex)))
    # A row for each file: how many features the files before it have.
    sizes = docs.select(F.col("_metadata.file_path").alias("path"), F.size("features").alias("n"))
    before = sizes.select(F.col("path").alias("of"), (F.sum("n").over(Window.orderBy("path")) - F.col("n")).alias("before"))
    counted = f.join(before, F.col("path") == F.col("of"))
    return counted.select((F.col("before") + F.col("i")).alias("shape_id"), F.col("f.properties").alias("properties"), geom.alias("geom"))


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """``(shape_id, properties, geom)`` of the placemarks of KML files that have polygons, by Spark's XML source, which splits files at
    placemarks. Names, descriptions and data fields become properties. Ids are distinct and ascend with the file and place, with gaps.
    """
    ring = "struct<LinearRing:struct<coordinates:string>>"
    polygon = f"array<struct<outerBoundaryIs:{ring},innerBoundaryIs:array<{ring}>>>"
    pair = lambda value: f"array<struct<_name:string,{value}:string>>"
    data = f"struct<Data:{pair('value')},SchemaData:struct<SimpleData:{pair('_VALUE')}>>"
    marks = spark.read.format("xml").option("rowTag", "Placemark").schema(f"name string, description string, ExtendedData {data}, Polygon {polygon}, MultiGeometry struct<Polygon:{polygon}>").load(path)
    numbers = lambda t: F.transform(F.split(t, ","), lambda x: x.cast("double"))

    def vertices(r: Column) -> Column:
        points = F.transform(F.filter(F.split(r["LinearRing"]["coordinates"], r"\s+"), lambda t: t != ""), lambda t: F.struct(numbers(t)[0].alias("x"), numbers(t)[1].alias("y")))
        return without_repeats(points)

    polygons = F.concat(F.coalesce("Polygon", F.array().cast(polygon)), F.coalesce("MultiGeometry.Polygon", F.array().cast(polygon)))
    geom = F.transform(polygons, lambda p: F.concat(F.array(vertices(p["outerBoundaryIs"])), F.transform(F.coalesce(p["innerBoundaryIs"], F.array().cast(f"array<{ring}>")), vertices)))
    entry = lambda name, value: F.when(F.col(value).isNotNull(), F.struct(F.lit(name).alias("key"), F.col(value).alias("value")))
    fields = lambda c, value: F.coalesce(F.transform(c, lambda d: F.struct(d["_name"].alias("key"), d[value].alias("value"))), F.array().cast("array<struct<key:string,value:string>>"))
    own = F.array_compact(F.array(entry("name", "name"), entry("description", "description")))
    told = F.concat(own, fields("ExtendedData.Data", "value"), fields("ExtendedData.SchemaData.SimpleData", "_VALUE"))
    last = F.map_from_entries(F.filter(told, lambda e: F.size(F.filter(told, lambda o: o["key"] == e["key"])) == 1))
    return marks.select(F.monotonically_increasing_id().alias("shape_id"), last.alias("properties"), geom.cast(GEOMETRY).alias("geom")).where("size(geom) > 0")


def with_columns(shapes: DataFrame, names: list[str]) -> DataFrame:
    """Properties as columns of text; mended where they were read in the wrong codepage."""
    return shapes.select("shape_id", *(F.coalesce(demojibake(F.col("properties")[n]), F.col("properties")[n]).alias(n) for n in names), "geom")


def property_names(shapes: DataFrame) -> list[str]:
    """All property names of a layer, sorted; a few dozen."""
    return sorted(r.n for r in shapes.select(F.explode(F.map_keys("properties")).alias("n")).distinct().collect())


def scheme(columns: list[str], name_scores: dict[str, float] | None = None) -> dict:
    """Which scheme a layer follows, by its columns: ``dataset, confidence, name, parent, types, alias, level``.

    Vietnam's own columns, then GADM's numbered ones (level 0 is an outline, no tier), then geoBoundaries'; else the column that reads most
    like names, by the scores given, ``likely`` if it is clear of the next by a quarter, else ``ask``.
    """
    by = {c.lower(): c for c in reversed(columns)}
    out = {"dataset": "generic", "confidence": "ask", "name": None, "parent": None, "types": [], "alias": None, "level": None}
    province, commune = by.get("ten_tinh"), by.get("ten_xa")
    if province or commune:
        return out | {"dataset": "vietnam", "confidence": "sure", "name": commune or province, "parent": province if commune else None, "alias": by.get("sap_nhap"), "level": 2 if commune else 1}
    if "gid_0" in by:
        levels = [i for i in range(1, 6) if f"name_{i}" in by]
        country = by.get("country") or by.get("name_0")
        if levels:
            i = max(levels)
            types = [by[c] for c in (f"type_{i}", f"engtype_{i}") if c in by]
            return out | {"dataset": "gadm", "confidence": "sure", "name": by[f"name_{i}"], "parent": by.get(f"name_{i - 1}") if i > 1 else None, "types": types, "alias": by.get(f"varname_{i}"), "level": i}
        if country:
            return out | {"dataset": "gadm", "confidence": "sure", "name": country, "level": 0}
    if "shapename" in by and "shapegroup" in by:
        return out | {"dataset": "geoboundaries", "confidence": "sure", "name": by["shapename"]}
    ranked = sorted(((s, c) for c, s in (name_scores or {}).items()), reverse=True)
    if not ranked or ranked[0][0] <= 0:
        return out
    clear = ranked[0][0] - (ranked[1][0] if len(ranked) > 1 else 0.0)
    return out | {"confidence": "likely" if clear >= 0.25 else "ask", "name": ranked[0][1]}


def tier_roles(tiers: DataFrame) -> DataFrame:
    """``tiers(tier, units)`` to the same with ``role``: the fewest units are the coarse tier, ``province``, the next the fine one,
    ``commune``; outlines of one unit and tiers beyond those have none. A country may have one tier."""
    place = F.row_number().over(Window.orderBy(F.when(F.col("units") > 1, F.col("units")).asc_nulls_last(), "tier"))
    role = F.when(F.col("units") > 1, F.get(F.array(F.lit("province"), F.lit("commune")), place - 1))
    return tiers.withColumn("role", role)
