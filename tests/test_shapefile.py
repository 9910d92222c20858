"""Shapefiles: round trips, ranges, code pages; GeoJSON and KML of the same features."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from terrafold.functions.geometry import GEOMETRY
from terrafold.sources import boundaries, shapefile

SQUARE = lambda x, s=1.0: [(x, 0.0), (x + s, 0.0), (x + s, s), (x, s)]


def rings(*parts):
    return [[[{"x": float(a), "y": float(b)} for a, b in r] for r in p] for p in parts]


@pytest.fixture(scope="module")
def layer(spark):
    rows = [(k, f"Xã Huế {k}", None if k % 7 == 0 else k * 1.5, rings([SQUARE(3 * k, 2), SQUARE(3 * k + 0.5, 0.5)[::-1]], [SQUARE(500 + k)]) if k % 5 else None) for k in range(200)]
    return spark.createDataFrame(rows, f"id long, ten_xa string, `a_long_column_name` double, geom {GEOMETRY}")


def test_round_trip(spark, layer, tmp_path):
    folder = f"file://{tmp_path}/layer"
    written = shapefile.write_shapefiles(layer.repartition(3), folder, ["id", "ten_xa", "a_long_column_name"]).collect()
    assert len(written) == 3 and sum(r.features for r in written) == 200
    assert sum(n for _, n in shapefile.layer_files(folder)) == 200
    back = shapefile.read_shapefiles(spark, folder, range_bytes=2000)
    assert back.rdd.getNumPartitions() > 12
    got = {int(r.properties["id"]): (r.properties["ten_xa"], r.properties["a_long_col"], r.geom) for r in back.collect()}
    want = {r.id: (r.ten_xa, None if r.a_long_column_name is None else str(r.a_long_column_name), r.geom or []) for r in layer.collect()}
    assert got == want
    assert sorted(r.shape_id for r in back.select("shape_id").collect()) == list(range(200))
    assert shapefile.layer_units(spark, {"communes": folder}).first().units == 200


def test_equals_its_geojson(spark, layer, tmp_path):
    shapefile.write_shapefiles(layer.coalesce(1), f"file://{tmp_path}/shp", ["id", "ten_xa"]).collect()
    close = lambda r: [[v["x"], v["y"]] for v in [*r, r[0]]]
    features = [{"type": "Feature", "properties": {"id": str(r.id), "ten_xa": r.ten_xa}, "geometry": {"type": "MultiPolygon", "coordinates": [[close(g) for g in p] for p in r.geom or []]}} for r in layer.collect()]
    for k, some in enumerate((features[:150], features[150:])):
        (tmp_path / f"{k}.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": some}))
    a = shapefile.read_shapefiles(spark, f"{tmp_path}/shp").collect()
    b = boundaries.read_geojson(spark, f"{tmp_path}/*.geojson").collect()
    assert sorted((r.shape_id, r.properties["ten_xa"], str(r.geom)) for r in a) == sorted((r.shape_id, r.properties["ten_xa"], str(r.geom)) for r in b)


@pytest.mark.parametrize("page,codec,repair", [("UTF-8", "utf-8", False), ("1258", "cp1258", False), (None, "utf-8", True), (None, "latin-1", False), ("ISO-8859-1", "latin-1", False)])
def test_code_pages(spark, tmp_path, page, codec, repair):
    df = spark.createDataFrame([(1, "Hué", rings([SQUARE(0)])), (2, "plain", rings([SQUARE(2)]))], f"id long, name string, geom {GEOMETRY}")
    base = shapefile.write_shapefiles(df.coalesce(1), f"{tmp_path}/x", ["id", "name"]).first().base
    with open(base + ".dbf", "rb") as f:
        data = f.read()
    wide = "Hué".encode()
    with open(base + ".dbf", "wb") as f:
        f.write(data.replace(wide, "Hué".encode(codec).ljust(len(wide))))
    import os

    os.remove(base + ".cpg")
    if page:
        with open(base + ".cpg", "w") as f:
            f.write(page)
    shapes, found = shapefile.repaired(shapefile.read_shapefiles(spark, f"{tmp_path}/x"))
    assert [r.properties["name"] for r in shapes.orderBy("shape_id").collect()] == ["Hué", "plain"]
    assert [tuple(r) for r in found.collect()] == ([("name", 1, "HuÃ©", "Hué")] if repair else [])


def test_deleted_records_and_missing_index(spark, tmp_path):
    df = spark.createDataFrame([(k, rings([SQUARE(k)])) for k in range(4)], f"id long, geom {GEOMETRY}")
    base = shapefile.write_shapefiles(df.coalesce(1), f"{tmp_path}/x", ["id"]).first().base
    data = bytearray(open(base + ".dbf", "rb").read())
    head, width = struct.unpack_from("<HH", data, 8)
    data[head + width] = ord("*")
    open(base + ".dbf", "wb").write(data)
    assert [(r.shape_id, r.properties["id"]) for r in shapefile.read_shapefiles(spark, base + ".shp").orderBy("shape_id").collect()] == [(0, "0"), (2, "2"), (3, "3")]
    import os

    os.remove(base + ".shx")
    with pytest.raises(FileNotFoundError):
        shapefile.layer_files(f"{tmp_path}/x")


def test_no_rows(spark, layer, tmp_path):
    assert shapefile.write_shapefiles(layer.limit(0), f"{tmp_path}/x", ["id"]).count() == 0
    with pytest.raises(ValueError, match="ten bytes"):
        shapefile.write_shapefiles(layer.select("geom", F.lit(1).alias("long_name_a"), F.lit(1).alias("long_name_b")), f"{tmp_path}/y", ["long_name_a", "long_name_b"])


def test_kml(spark, tmp_path):
    mark = lambda name, body: f"<Placemark><name>{name}</name><ExtendedData><Data name='code'><value>{name[-1]}</value></Data><SchemaData><SimpleData name='pop'>7</SimpleData></SchemaData></ExtendedData>{body}</Placemark>"
    poly = lambda *rs: "<Polygon><outerBoundaryIs><LinearRing><coordinates>" + "</coordinates></LinearRing></outerBoundaryIs><innerBoundaryIs><LinearRing><coordinates>".join(rs) + f"</coordinates></LinearRing></{'inner' if len(rs) > 1 else 'outer'}BoundaryIs></Polygon>"
    a, b = "0,0,5 4,0,5\n 4,4 0,4 0,0", "1,1 1,2 2,2 1,1"
    (tmp_path / "k.kml").write_text(f"<kml><Document>{mark('A', poly(a, b))}{mark('B', f'<MultiGeometry>{poly(a)}{poly(b)}</MultiGeometry>')}{mark('C', '<Point><coordinates>1,1</coordinates></Point>')}</Document></kml>")
    rows = boundaries.read_kml(spark, str(tmp_path)).orderBy("shape_id").collect()
    assert [r.properties for r in rows] == [{"name": n, "code": n, "pop": "7"} for n in "AB"]
    big, small = [(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (1, 2), (2, 2)]
    assert [[[[tuple(v) for v in g] for g in p] for p in r.geom] for r in rows] == [[[big, small]], [[big], [small]]]
