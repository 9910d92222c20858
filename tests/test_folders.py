"""Boundary folders: countries, tiers by role and folder, a country of one tier, refusals; adopting files; profiles."""

import json

import pytest

from terrafold.operators import profile as pf
from terrafold.sources import folders as fo


def layer(path, names, **fixed):
    ring = lambda i: [[[i, 0], [i + 1, 0], [i + 1, 1], [i, 1], [i, 0]]]
    features = [{"type": "Feature", "properties": {"name": n, **fixed}, "geometry": {"type": "Polygon", "coordinates": ring(i)}} for i, n in enumerate(names)]
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}))


@pytest.fixture
def root(tmp_path):
    layer(tmp_path / "here" / "state" / "s.geojson", ["a", "b"])
    layer(tmp_path / "here" / "county" / "c.json", ["a1", "a2", "b1"])
    layer(tmp_path / "here" / "whole" / "w.geojson", ["Here"], GID_0="HER", COUNTRY="Here")
    layer(tmp_path / ".hidden" / "state" / "s.geojson", ["x"])
    (tmp_path / "empty" / "state").mkdir(parents=True)
    (tmp_path / "empty" / "state" / "notes.txt").write_text("no layer")
    return tmp_path


def test_roles_by_units(spark, root):
    listing = fo.layer_listing(spark, str(root))
    assert fo.countries(listing) == ["here"] and fo.resolve_country(listing) == "here"
    tiers = fo.country_tiers(spark, listing, "here")
    assert sorted((r.tier, r.units, r.role) for r in tiers.collect()) == [("county", 3, "commune"), ("state", 2, "province"), ("whole", 1, None)]
    assert fo.resolve_tier(tiers, "county")["tier"] == fo.resolve_tier(tiers, "commune")["tier"] == "county"
    assert fo.resolve_tier(tiers, "state")["role"] == "province"
    assert sorted(r.n for r in fo.fine_tier(spark, tiers).selectExpr("properties['name'] AS n").collect()) == ["a1", "a2", "b1"]
    with pytest.raises(ValueError, match=r"no tier 'whole'; there are whole \(1\), state \(2\), county \(3\)"):
        fo.resolve_tier(tiers, "whole")


def test_several_countries_and_one_tier(spark, root):
    layer(root / "there" / "only" / "o.geojson", ["There"])
    listing = fo.layer_listing(spark, str(root))
    assert fo.countries(listing) == ["here", "there"] and fo.resolve_country(listing, "there") == "there"
    with pytest.raises(ValueError, match="here, there"):
        fo.resolve_country(listing)
    with pytest.raises(ValueError, match="no country 'empty'"):
        fo.resolve_country(listing, "empty")
    tiers = fo.country_tiers(spark, listing, "there")
    assert [(r.tier, r.units, r.role) for r in tiers.collect()] == [("only", 1, "province")]
    assert fo.fine_tier(spark, tiers) is None
    with pytest.raises(ValueError, match="no country has a layer"):
        fo.resolve_country(fo.layer_listing(spark, str(root / "empty")))


def test_one_layer_in_a_folder(spark):
    assert fo.one_layer([("a", "kml", "a.kml"), ("a", "geojson", "a.geojson"), ("n", "txt", "n.txt")], "t") == "a.geojson"
    assert fo.one_layer([("a", "shp", "a.shp"), ("a", "shx", ""), ("a", "dbf", ""), ("a", "kml", "a.kml")], "t") == "a.shp"
    for files, said in [([("a", "kml", ""), ("b", "kml", "")], "several layers"), ([("a", "shp", ""), ("a", "dbf", "")], "lacks a.shx"), ([("a", "txt", "")], "no layer")]:
        with pytest.raises(ValueError, match=said):
            fo.one_layer(files, "t")


def test_adopting(spark, tmp_path):
    given, folder = tmp_path / "x" / "my data.csv", tmp_path / "input"
    given.parent.mkdir()
    given.write_text("a;b\n1;2\n")
    name = lambda: (lambda path, said: (path.rpartition("/")[2], said))(*fo.adopt(spark, str(given), str(folder)))
    assert name() == ("my data.csv", "copied") and name() == ("my data.csv", "already_present")
    given.write_text("a;b\n1;3\n")  # as long as before
    assert name() == ("my data_02.csv", "copied") and name() == ("my data_02.csv", "already_present")
    assert (folder / "my data.csv").read_text() == "a;b\n1;2\n" and (folder / "my data_02.csv").read_text() == "a;b\n1;3\n"
    with pytest.raises(FileNotFoundError):
        fo.adopt(spark, str(tmp_path / "none.csv"), str(folder))
    (tmp_path / "x" / "page.html").write_text("")
    with pytest.raises(ValueError, match="no table"):
        fo.adopt(spark, str(tmp_path / "x" / "page.html"), str(folder))


def test_place_candidates(spark):
    key = lambda *names: spark.createDataFrame([(n,) for n in names], "key string")
    rows = [("p", "p", "c1", "x")] * 3 + [("q", "p", "c2", None), ("q", "p", "zz", None), (None, "p", "c3", None)]
    df = spark.createDataFrame(rows, "province string, same string, commune string, other string")
    got = pf.place_candidates(df, df.columns, key("p", "q"), key("p", "c1", "c2", "c3"), "").collect()
    assert sorted((r.tier, r.rank, r.column, round(r.match_rate, 3), r.distinct_values) for r in got) == [
        ("commune", 1, "commune", 0.833, 4), ("commune", 2, "province", 0.6, 2), ("commune", 3, "same", 1.0, 1), ("province", 1, "province", 1.0, 2), ("province", 2, "same", 1.0, 1),
    ]
    assert pf.place_candidates(df, [], key("p"), None, "").count() == 0
