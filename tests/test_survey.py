"""Survey verdicts of sheets side by side."""

from pyspark.sql import functions as F

from terrafold.operators.numbering import numbered
from terrafold.operators.survey import survey_files, survey_sheets


def cells(path, sheet, rows):
    return [(path, sheet, i, j, v) for i, r in enumerate(rows) for j, v in enumerate(r) if v is not None]


def test_verdicts(spark):
    body = [["Alder", "Oak Town", "5"], ["Birch", "Elm Town", "6"], ["Alder", "Ash Town", "7"]]
    data = [
        *cells("a", "good", [["Report"], [], ["Region", "Town", "Cases"], *body]),
        *cells("a", "head only", [["Region", "Town", "Cases"], [None, None, " "]]),
        *cells("a", "unnamed", [["Region", "Town"], ["Alder", "Oak Town", "1", "2", "3", "4"], ["Birch", "Elm Town", "1", "2", "3", "4"]]),
        *cells("b", "two", [["Region", "Cases"], ["Alder", "1"], ["Birch", "2"], [], [], [], ["Budget", "Money"], ["x", "9"], ["y", "8"]]),
        *cells("b", "coarse", [["Region", "Name"], ["Alder", "p"], ["Birch", "q"]]),
        *cells("b", "long", [["Region", "Name"], *[["Alder", "p"]] * 400]),
    ]
    df = spark.createDataFrame(data, "path string, sheet string, row int, col int, value string").repartition(4)
    keys = lambda *ks: spark.createDataFrame([(k,) for k in ks], "key string")
    rows = {r.sheet: r for r in survey_sheets(df, keys("alder", "birch"), keys("oak town", "elm town", "ash town", "alder"), "").collect()}
    seen = {s: (r.verdict, r.header_row, r.n_columns, r.n_rows, r.n_tables, r.province_column, r.commune_column, r.level) for s, r in rows.items()}
    assert seen["good"] == ("ok", 2, 3, 3, 1, "Region", "Town", "commune")
    assert seen["head only"][0] == "no-rows" and seen["unnamed"][0] == "unnamed-columns"
    assert seen["two"] == ("no-place-column", 0, 2, 8, 2, None, None, None)
    assert seen["coarse"] == ("ok", 0, 2, 2, 1, "Region", None, "province") and seen["long"][3] == 400
    files = {r.path: (r.sheets, r.usable, r.preferred) for r in survey_files(survey_sheets(df, keys("alder", "birch"), None, "")).collect()}
    assert files == {"a": (3, 1, ["good"]), "b": (3, 2, ["coarse", "long"])}
    assert survey_sheets(df.limit(0), keys("alder"), None, "").count() == 0


def test_numbers_over_ranges(spark, monkeypatch):
    from terrafold.operators import numbering

    monkeypatch.setattr(numbering, "RANGE_ROWS", 10)
    df = spark.range(95).select((F.col("id") * 37 % 95).alias("k"), F.lit("x").alias("range"))
    assert sorted((r.k, r.n) for r in numbered(df, ["k"], "n").collect()) == [(i, i) for i in range(95)]
    assert numbered(df.limit(0), ["k"], "n").count() == 0
