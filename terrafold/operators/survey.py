"""What the sheets of many workbooks hold, and whether they can be mapped, in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, normalize
from .grid import header_row, table_blocks

#: Rows of each sheet that are looked at.
SURVEY_ROWS = 300
#: Parts of a column's distinct values that must be names of the coarse or of the fine tier.
PROVINCE_SHARE, COMMUNE_SHARE = 0.6, 0.85
UNNAMED_SHARE = 0.5
BY = ["path", "sheet"]


def survey_sheets(cells: DataFrame, provinces: DataFrame, communes: DataFrame | None, affixes: str) -> DataFrame:
    """``cells(path, sheet, row, col, value)`` to a row for each sheet: ``path, sheet, verdict, header_row, n_columns, n_rows, n_tables,
    province_column, commune_column, level``.

    The first SURVEY_ROWS rows tell the header, the tables and which columns hold names of either tier (``provinces(key)``,
    ``communes(key)``; names of both count as provinces), by distinct values; ``n_rows`` estimates the rows below the header from the
    last one. The verdict is ok, sheet-empty, no-rows, unnamed-columns or no-place-column. Everything is grouped by sheet, so that sheets
    are judged together and a large one meets in its sample only. Rows and columns count from zero. Empty input: no rows.
    """
    filled = ~is_blank(F.col("value"))
    sample = cells.where(F.col("row") < SURVEY_ROWS)
    sheets = cells.groupBy(*BY).agg(F.max("row").alias("last"))
    width = sample.groupBy(*BY).agg((F.max("col") + 1).alias("n_columns"), F.count_if(filled).alias("filled"))
    header = header_row(sample, by=BY).select(*BY, F.col("row").alias("header_row"))
    tables = table_blocks(sample, by=BY).groupBy(*BY).agg(F.count("*").alias("n_tables"))
    placed = sample.where(filled).join(header, BY)
    names = placed.where(F.col("row") == F.col("header_row")).groupBy(*BY, "col").agg(F.first(F.trim("value")).alias("name"))
    body = placed.where(F.col("row") > F.col("header_row"))
    counted = body.groupBy(*BY).agg(F.countDistinct("row").alias("seen"))

    known = provinces.select("key", F.lit("p").alias("tier"))
    if communes is not None:
        known = known.unionByName(communes.select("key", F.lit("c").alias("tier")).join(provinces.select("key"), "key", "left_anti"))
    values = body.select(*BY, "col", normalize(F.col("value"), affixes).alias("key")).where("key <> ''").distinct().join(known.distinct(), "key", "left")
    share = lambda tier: F.coalesce(F.count_if(F.col("tier") == tier) / F.count("*"), F.lit(0.0))
    shares = values.groupBy(*BY, "col").agg(share("p").alias("p"), share("c").alias("c")).join(names, [*BY, "col"], "left")
    title = F.coalesce("name", F.concat(F.lit("Unnamed: "), "col"))
    # The highest share, of equal ones the first column.
    best = lambda c, least: F.min_by(F.when(F.col(c) >= least, title), F.when(F.col(c) >= least, F.struct((-F.col(c)).alias("less"), "col")))
    places = shares.groupBy(*BY).agg(best("p", PROVINCE_SHARE).alias("province_column"), best("c", COMMUNE_SHARE).alias("commune_column"))
    named = names.groupBy(*BY).agg(F.count_if(~F.lower("name").startswith("unnamed")).alias("named"))

    out = sheets
    for part in (width, header, tables, counted, places, named):
        out = out.join(part, BY, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    place = F.coalesce("commune_column", "province_column")
    verdict = (
        F.when(zero("filled") == 0, "sheet-empty").when(zero("seen") == 0, "no-rows").when((F.col("n_columns") - zero("named")) / F.col("n_columns") > UNNAMED_SHARE, "unnamed-columns")
        .when(place.isNull(), "no-place-column").otherwise("ok")
    )
    level = F.when(F.col("commune_column").isNotNull(), "commune").when(F.col("province_column").isNotNull(), "province")
    rows = F.when(zero("filled") > 0, F.greatest(F.col("last") - F.col("header_row"), zero("seen"))).otherwise(0).cast("long")
    return out.select(*BY, verdict.alias("verdict"), "header_row", "n_columns", rows.alias("n_rows"), zero("n_tables").alias("n_tables"), "province_column", "commune_column", level.alias("level"))


def survey_files(surveyed: DataFrame) -> DataFrame:
    """A row for each workbook: ``path, sheets, usable, preferred`` (its usable sheets, by name)."""
    ok = F.col("verdict") == "ok"
    return surveyed.groupBy("path").agg(F.count("*").alias("sheets"), F.count_if(ok).alias("usable"), F.array_sort(F.collect_list(F.when(ok, F.col("sheet")))).alias("preferred"))
