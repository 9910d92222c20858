"""Sources: dialects, workbooks, boundary layers, stores; and planning functions without a table."""

import json
import zipfile

import pytest

from terrafold.operators import geo, grid, longform, semantics
from terrafold.plans import mapquery
from terrafold.sources import boundaries, delimited, workbook


@pytest.mark.parametrize(
    "head, want",
    [
        ("a;b;c\n1;2;3\n4;5;6\n".encode("utf-8-sig"), ("UTF-8", ";")),
        ("tỉnh\tsố\nHà Nội\t1\nHuế\t2\n".encode(), ("UTF-8", "\t")),
        ("name|n\nx|1\ny|2\n".encode(), ("UTF-8", "|")),
        (b"caf\xe9,n\nx,1\n", ("windows-1258", ",")),
        (b"one\ntwo\n", ("UTF-8", ",")),
        (b"", ("UTF-8", ",")),
    ],
)
def test_dialect(head, want):
    assert delimited.text_dialect(head) == want


def test_dialect_cut_within_a_character():
    assert delimited.text_dialect(("ế" * 30_000).encode()[: delimited.PEEKED])[0] == "UTF-8"


def test_delimited_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "t.csv").write_bytes("Tỉnh;Số ca;Ghi chú\nHà Nội;1.234;\"a;b\"\nHuế;5,5;\n;-;x\n".encode("utf-8-sig"))
    (tmp_path / "in" / "~$t.csv").write_text("")
    assert [r.path.rpartition("/")[2] for r in delimited.list_tables(spark, f"{tmp_path}/in").collect()] == ["t.csv"]
    df = delimited.read_delimited(spark, f"{tmp_path}/in/t.csv")
    assert df.columns == ["Tỉnh", "Số ca", "Ghi chú"] and df.count() == 3
    numbers, unread = delimited.coerced(df)
    assert [r["Số ca"] for r in numbers.collect()] == [1234.0, 5.5, None] and unread == {"Số ca": 0}
    delimited.write_csv(numbers, f"{tmp_path}/out")
    assert delimited.read_review(spark, f"{tmp_path}/out", "Tỉnh string", ["Tỉnh"]).count() == 3
    assert delimited.read_review(spark, f"{tmp_path}/out", "Tỉnh string", ["absent"]) is None
    delimited.write_json(numbers, f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json").count() == 3
    assert [(r.column, r.meaning) for r in delimited.data_dictionary(df.select("Tỉnh", "Số ca")).orderBy("column").collect()] == [("Huế", "5,5"), ("Hà Nội", "1.234")]
    assert delimited.is_dictionary("Từ điển dữ liệu") and not delimited.is_dictionary("Sheet1")


def test_remembered(spark, tmp_path):
    store = f"{tmp_path}/store"
    schema = "key string, name string, value string, at long"
    for at, value in enumerate(("first", "second")):
        delimited.remember(spark, store, spark.createDataFrame([("File::Sheet", "Ha Noi", value, at)], schema))
    assert [tuple(r) for r in delimited.remembered(spark, store).collect()] == [("file::sheet", "ha noi", "second")]


def book(path, rows, merges):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    cells = "".join(f'<row r="{i + 1}">' + "".join(f'<c r="{chr(65 + k)}{i + 1}" t="inlineStr"><is><t>{v}</t></is></c>' for k, v in enumerate(r) if v) + "</row>" for i, r in enumerate(rows))
    merged = "".join(f'<mergeCell ref="{m}"/>' for m in merges)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="Báo cáo" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{cells}</sheetData><mergeCells>{merged}</mergeCells></worksheet>")


def test_workbook(spark, tmp_path):
    book(tmp_path / "r.xlsx", [["Title"], [], ["Tỉnh", "Ca", None], [None, "Nam", "Nữ"], ["A", "1", "2"], [None, "3", "4"], ["B", "5", "6"]], ["A3:A4", "B3:C3", "A5:A6"])
    cells, merges = workbook.read_workbooks(spark, str(tmp_path))
    assert {(m.r0, m.c0, m.r1, m.c1) for m in merges.collect()} == {(2, 0, 3, 0), (2, 1, 2, 2), (4, 0, 5, 0)}
    g, m = cells.select("row", "col", "value"), merges.select("r0", "c0", "r1", "c1")
    filled = grid.fill_merged(g, m)
    top = grid.header_top(m, 3)
    depth = grid.header_depth(m, top)
    assert (top, depth) == (2, 2)
    names = [r.name for r in grid.joined_header(filled, top, depth).orderBy("col").collect()]
    assert names == ["Tỉnh", "Ca - Nam", "Ca - Nữ"]
    table = grid.as_table(filled, names, top + depth)
    assert sorted(tuple(r)[1:] for r in table.collect()) == [("A", "1", "2"), ("A", "3", "4"), ("B", "5", "6")]
    assert workbook.place("BC12") == (11, 54)


def test_headers_keep_repeats_that_are_apart(spark):
    cells = [(0, 0, "A"), (1, 0, "B"), (2, 0, "A"), (0, 1, "A"), (1, 1, "A")]
    out = grid.joined_header(spark.createDataFrame(cells, "row int, col int, value string"), 0, 3)
    assert [r.name for r in out.orderBy("col").collect()] == ["A - B - A", "A"]


def test_geojson_and_schemes(spark, tmp_path):
    square = lambda x: [[[x, 0], [x + 1, 0], [x + 1, 1], [x, 1], [x, 0]]]
    features = [
        {"type": "Feature", "properties": {"GID_0": "X", "NAME_1": "Alder", "TYPE_1": "Region", "COUNTRY": "F"}, "geometry": {"type": "Polygon", "coordinates": square(0)}},
        {"type": "Feature", "properties": {"GID_0": "X", "NAME_1": "HuÃ©", "TYPE_1": "Region", "COUNTRY": "F"}, "geometry": {"type": "MultiPolygon", "coordinates": [square(2), square(5)]}},
        {"type": "Feature", "properties": {"NAME_1": "none"}, "geometry": {"type": "Point", "coordinates": [0, 0]}},
    ]
    (tmp_path / "b.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    shapes = boundaries.read_geojson(spark, f"{tmp_path}/b.geojson")
    names = boundaries.property_names(shapes)
    found = boundaries.scheme(names)
    assert (found["dataset"], found["name"], found["types"], found["level"]) == ("gadm", "NAME_1", ["TYPE_1"], 1)
    rows = boundaries.with_columns(shapes, ["NAME_1"]).orderBy("shape_id").collect()
    assert [r.NAME_1 for r in rows] == ["Alder", "Hué", "none"] and rows[2].geom is None
    assert [r.area for r in geo.shape_facts(shapes.where("geom is not null")).orderBy("shape_id").collect()] == [1.0, 2.0]


def test_scheme_order():
    assert boundaries.scheme(["ten_tinh", "TEN_XA", "GID_0", "NAME_1"])["name"] == "TEN_XA"
    assert boundaries.scheme(["GID_0", "COUNTRY"])["level"] == 0
    assert boundaries.scheme(["shapeName", "shapeGroup"])["dataset"] == "geoboundaries"
    assert boundaries.scheme(["a", "b"], {"a": 0.9, "b": 0.5})["confidence"] == "likely"
    assert boundaries.scheme(["a", "b"], {"a": 0.9, "b": 0.8})["confidence"] == "ask"
    assert boundaries.scheme(["a"])["name"] is None


def test_hull_takes_in_fragments_through_others(spark):
    square = lambda x, y, s=1.0: [[(x, y), (x + s, y), (x + s, y + s), (x, y + s)]]
    shapes = spark.createDataFrame([(1, [square(0.0, 0.0, 2.0), square(3.0, 0.0), square(5.0, 0.0), square(60.0, 0.0)])], "shape_id int, geom array<array<array<struct<x:double,y:double>>>>")
    row = geo.main_parts(shapes).first()
    assert row.kept == [0, 1, 2] and row.share == pytest.approx(6 / 7)


def test_masses_by_outlines_not_boxes(spark):
    """An L and a square in its notch: boxes overlap, outlines are 0.5 apart."""
    ell, dot = [[(0.0, 0.0), (4.0, 0.0), (4.0, 1.0), (1.0, 1.0), (1.0, 4.0), (0.0, 4.0)]], [[(1.5, 1.5), (3.0, 1.5), (3.0, 3.0), (1.5, 3.0)]]
    shapes = spark.createDataFrame([(1, [ell]), (2, [dot])], "shape_id int, geom array<array<array<struct<x:double,y:double>>>>")
    assert geo.land_masses(shapes, 0.4).count() == 2 and geo.land_masses(shapes, 0.6).count() == 1


def test_planning():
    assert geo.declared_inset("Viet-Nam") == (111.0, "built_in") and geo.declared_inset("X") == (None, "undeclared")
    assert geo.declared_inset("viet nam", {"inset_meridian": None}) == (None, "declared_as_none")
    with pytest.raises(ValueError):
        geo.declared_inset("X", {"inset_meridian": 200})
    assert semantics.resolve_method("auto", "rate-per-capita", True) == "weighted-mean" and semantics.resolve_method("auto", "rate-per-capita", False) == "mean"
    assert semantics.resolve_method("auto", "count", False) == "sum" and semantics.resolve_method("max", "count", False) == "max"
    assert semantics.describe_method("weighted-mean", "n") == "a weighted mean on 'n'"
    assert longform.parse_layer("A / B|Status/Result=x") == {"name": "A ÷ B (%)", "numerator": "A", "denominator": "B", "pins": {"Status/Result": "x"}}
    assert longform.measure_column({"Value": True, "n": True}) == "Value" and longform.measure_column({"n": True, "t": False}) == "n" and longform.measure_column({"a": True, "b": True}) is None
    assert mapquery.conflicts([("a", "percent"), ("b", "category"), ("c", "count")]) == ["fill-taken", "category-beside-continuous"]
    assert len(mapquery.MapSpec("boundary").token()) == 8 and mapquery.MapSpec("boundary").token() != mapquery.MapSpec("point").token()


def test_where_says_what_is_near(spark):
    df = spark.createDataFrame([("Male", 1), ("Female", 2)], "sex string, n int")
    assert longform.checked_where(df, ["sex= Male "]).count() == 1
    with pytest.raises(ValueError, match="nearest: "):
        longform.checked_where(df, ["sex=Mal"])
    with pytest.raises(ValueError, match="no column"):
        longform.checked_where(df, ["x=1"])


def test_workbook_values(spark, tmp_path):
    """Dates by built-in and own formats, times, truth values, errors, bare cells, rich and shared strings."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    cells = """<row r="2"><c r="B2" s="1"><v>45292</v></c><c s="2"><v>45292.5625</v></c><c s="3"><v>0.5</v></c><c><v>45292</v></c></row>
    <row><c t="b"><v>1</v></c><c t="b"><v>0</v></c><c t="e"><v>#N/A</v></c><c t="s"><v>0</v></c><c t="d"><v>2024-05-01</v></c><c t="str"><v>f</v></c><c s="4"><v>12.5</v></c><c s="1"><v>1</v></c></row>"""
    styles = f"""<styleSheet {ns}><numFmts><numFmt numFmtId="164" formatCode="[$-409]dd/mm/yyyy hh:mm"/><numFmt numFmtId="165" formatCode="0.0 &quot;days&quot;"/></numFmts>
    <cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="21"/><xf numFmtId="165"/></cellXfs></styleSheet>"""
    with zipfile.ZipFile(tmp_path / "v.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/styles.xml", styles)
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData>{cells}</sheetData><mergeCells><mergeCell ref="A5"/></mergeCells></worksheet>')
    found, merges = workbook.read_workbooks(spark, str(tmp_path))
    assert {(c.row, c.col): c.value for c in found.collect()} == {
        (1, 1): "2024-01-01", (1, 2): "2024-01-01 13:30:00", (1, 3): "12:00:00", (1, 4): "45292",
        (2, 0): "True", (2, 1): "False", (2, 3): "rich", (2, 4): "2024-05-01", (2, 5): "f", (2, 6): "12.5", (2, 7): "1900-01-01",
    }
    assert [(m.r0, m.c0, m.r1, m.c1) for m in merges.collect()] == [(4, 0, 4, 0)]
    assert workbook.moment("0", True) == "00:00:00" and workbook.moment("366", True) == "1905-01-01"
