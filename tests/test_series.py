"""Series: the two-period rule and its diagnosis, states of units without values; scopes, point sizes, ratios and changes."""

import duckdb
import pytest

from terrafold.operators import aggregate as agg
from terrafold.operators import classify as cl
from terrafold.operators.scope import contexts
from terrafold.plans.mapquery import MapSpec, needs_place_column
from terrafold.plans.series import animated, frame_states, period_pins
from terrafold.queries import QUERIES, SQL
from terrafold.queries.classes import quantile_sql
from terrafold.queries.maps import SERIES
from tests.support import duck, same_rows

ROWS = [(1, "2023", "a", 10.0, 4), (2, "2023", "a", 30.0, 16), (1, "2024", "b", 20.0, 1), (3, "2024", "b", 50.0, None), (2, "sometime", "a", 40.0, 9), (2, None, "a", 1000.0, 900), (2, " 2023 ", "a", 2.0, 0)]
SPEC = MapSpec("choropleth-symbol", value="v", method="auto", semantic="count", symbol="n", symbol_method="auto", classes=2, breaks="equal-interval")


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "shape_id int, period string, side string, v double, n int")


def test_one_scale_for_all_periods(rows):
    s = animated(rows, "period", SPEC)
    assert [r.period for r in s.periods.orderBy("ord").collect()] == ["2023", "2024", "sometime"]
    got = {(r.shape_id, r.period): (r.value, r.symbol, r.class_idx) for r in s.values.collect()}
    assert got == {(1, "2023"): (10.0, 4, 0), (2, "2023"): (32.0, 16, 1), (1, "2024"): (20.0, 1, 0), (3, "2024"): (50.0, None, 1), (2, "sometime"): (40.0, 9, 1)}
    assert s.largest == 16.0
    assert [(r.id, r.metric) for i in s.issues for r in i.collect() if r.id == "unreadable-periods"] == [("unreadable-periods", 1.0)]


def test_frames_hold_every_unit(spark, rows):
    s = animated(rows, "period", SPEC)
    units = spark.createDataFrame([(1,), (2,), (3,), (4,)], "shape_id int")
    got = {(r.frame, r.shape_id): (r.colour, r.radius) for r in frame_states(s, units).collect()}
    assert len(got) == 4 * (54 + 54 + 45)
    assert got[(0, 4)] == got[(152, 4)] == (cl.NO_DATA, 0.0)
    assert got[(0, 3)] == (cl.NO_DATA, 0.0)
    assert got[(54, 2)] == (cl.NO_DATA, 0.0)
    assert got[(0, 2)][1] == pytest.approx(0.021)
    assert got[(45, 2)][1] == pytest.approx(0.021 * 0.9)
    assert got[(0, 1)][1] == pytest.approx(0.0105)


def test_too_few_periods(rows):
    assert period_pins("period", ["side=a", " period = 2024", "period=x"]) == ["period=2024", "period=x"]
    with pytest.raises(ValueError, match="of the 3 periods of 'period', period=2024 leaves 1"):
        animated(rows, "period", SPEC, ["period=2024"])
    with pytest.raises(ValueError, match="'period' has 1 period; a series needs two"):
        animated(rows, "period", SPEC, ["side=b"])
    with pytest.raises(ValueError, match="has 0 periods"):
        animated(rows.where("false"), "period", SPEC)


def test_scopes(spark):
    units = spark.createDataFrame([(1, "p"), (2, "p"), (3, "q"), (4, "r"), (5, None)], "shape_id int, province string")
    some = spark.createDataFrame([(1, "p"), (1, "p"), (3, "q"), (None, None), (None, "r")], "shape_id int, province string")

    def drawn(matched, **how):
        scope, maps = contexts(units, matched, **how)
        return scope, sorted((r.map_name, r.shape_id, r.locator) for r in maps.collect())

    nation = [("national", i, None) for i in range(1, 6)]
    assert drawn(some) == ("province-series", [("p", 1, "p"), ("p", 2, "p"), ("q", 3, "q")])
    assert drawn(some, series_up_to=1) == ("national", nation)
    assert drawn(some, scope="national") == ("national", nation)
    assert drawn(some, scope="matched-only") == ("matched-only", [("units with data", 1, None), ("units with data", 3, None)])
    assert drawn(some, scope="single-province") == ("single-province", [("p", 1, "p"), ("p", 2, "p")])
    assert drawn(some.where("province = 'q'")) == ("single-province", [("q", 3, "q")])
    assert drawn(some.where("province = 'q'"), scope="matched-only") == ("matched-only", [("units with data", 3, "q")])
    assert drawn(some.where("false")) == ("national", nation)
    assert drawn(some, tier="province") == ("national", nation)
    assert drawn(some, tier="province", scope="matched-only") == ("national", [("national", 1, None), ("national", 3, None)])
    with pytest.raises(ValueError, match="unknown scope"):
        contexts(units, some, scope="all")


def test_points(spark):
    points = spark.createDataFrame([(1, "b", 4.0), (2, "a", 1.0), (3, None, -5.0), (4, "b", None), (5, "a", float("nan")), (6, "a", 0.01)], "id int, kind string, n double")
    out, legend, largest = cl.dressed_points(points, "kind", "n")
    got = {r.id: (r.colour, r.area) for r in out.collect()}
    a, b = cl.QUALITATIVE[:2]
    assert got == {1: (b, 676.0), 2: (a, 169.0), 3: (cl.NO_DATA, 16.0), 4: (b, 16.0), 5: (a, 16.0), 6: (a, 16.0)}
    assert largest == 4.0 and sorted(r.label for r in legend.collect()) == ["a", "b"]
    out, legend, largest = cl.dressed_points(points.where("n < 0"), size="n")
    assert legend is None and largest == 1.0 and out.first().area == 16.0
    with pytest.raises(ValueError, match="no column 'x'"):
        cl.dressed_points(points, size="x")


def test_ratio_and_change(spark):
    df = spark.createDataFrame([("p", 1.0, 4.0, 0.0), ("p", 1.0, 0.0, 0.0), ("q", 3.0, 4.0, 1.0)], "k string, `a/b` double, c double, d double")
    assert agg.split_ratio("a/b") == ("a/b", None) and agg.split_ratio("a/b / c") == ("a/b", "c") and agg.split_ratio(" / c") == (" / c", None)
    assert {r.k: r.ratio for r in agg.wide_ratio(df, ["k"], "a/b / c").collect()} == {"p": 50.0, "q": 75.0}
    assert {r.k: r.ratio for r in agg.wide_ratio(df, ["k"], "a/b / d").collect()} == {"p": None, "q": 300.0}
    assert agg.wide_ratio(df, ["k"], "a/b") is None
    with pytest.raises(ValueError, match="no column 'e'"):
        agg.wide_ratio(df, ["k"], "a/b / e")
    assert [r.change for r in agg.with_change(df, "c", "d").orderBy("k", "c").collect()] == [0.0, -4.0, -3.0]
    with pytest.raises(ValueError, match="no column '2026'"):
        agg.with_change(df, "c", "2026")


def test_auto_methods(spark):
    df = spark.createDataFrame([("p", 10.0, 1.0), ("p", 40.0, 3.0)], "k string, v double, w double")
    value = lambda **how: agg.combine(df, ["k"], "v", "auto", **how).first().value
    assert value(semantic="count") == 50.0 and value(semantic="percent", weight="w") == 32.5 and value(semantic="percent") == 25.0
    assert value(semantic="rate-per-capita", weight="w") == 32.5 and value(semantic="rate-per-capita") == 25.0 and value() == 25.0


def test_place_columns_needed():
    assert not needs_place_column("point", None, None, "province")
    assert not needs_place_column("choropleth", "p", None, "commune")
    assert needs_place_column("choropleth", None, "c", "province")
    assert not needs_place_column("choropleth", None, "c", "commune")
    assert needs_place_column("choropleth", None, None, "commune")


@pytest.mark.parametrize("name", ["frame_interpolation", "series_frames"])
def test_frames_of_merged_classes_match_sql(spark, tmp_path, name):
    """Full years lie so close beside a short one that quantiles merge; the colours stay those of the ramp of five."""
    con = duck()
    orders = f"SELECT c * 100 + y AS o_orderkey, c AS o_custkey, make_date(y::INT, 6, 1) AS o_orderdate, (CASE y WHEN 1994 THEN 40.0 WHEN 1993 THEN 60.0 ELSE 100.0 END + c / 10)::DOUBLE AS o_totalprice FROM range(0, 25) a(c), range(1990, 1995) b(y)"
    for table, rows in (("orders", orders), ("customer", "SELECT c AS c_custkey, c::INT AS c_nationkey FROM range(0, 25) t(c)"), ("nation", "SELECT * FROM nation"), ("region", "SELECT * FROM region")):
        con.execute(f"COPY ({rows}) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
    small = duckdb.connect()
    for table in ("orders", "customer", "nation", "region"):
        small.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet')")
    assert small.execute(f"WITH {quantile_sql(SERIES, 5)} SELECT count(*) FROM bins").fetchone()[0] < 5
    same_rows(QUERIES[name](spark, str(tmp_path)), SQL[name], small)
