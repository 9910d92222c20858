"""Untidy sheets as long cell grids ``(row, col, value)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank

SCANNED, BETTER, BELOW, GAP = 15, 1.15, 5, 2


def header_scores(grid: DataFrame, scan: int = SCANNED, by: list[str] | None = None) -> DataFrame:
    """``([by..], row, score)`` of the first rows of a sheet, or of each of several told apart by ``by``: width times the shares of text, of distinct names and of names of a sane length, if a filled
    row is among the next five; 0 under two cells."""
    filled = grid.where(~is_blank(F.col("value")) & (F.col("row") < scan + BELOW))
    text = ~F.trim("value").rlike(r"^[+-]?\d+(\.\d+)?$")
    per = filled.groupBy(*(by or []), "row").agg(
        F.count("*").alias("width"), F.count_if(text).alias("texts"), F.countDistinct(F.lower(F.trim("value"))).alias("names"), F.count_if(text & F.length(F.trim("value")).between(1, 60)).alias("sane")
    )
    score = F.col("width") * (F.col("texts") / F.col("width")) * (F.col("names") / F.col("width")) * (F.col("sane") / F.greatest("texts", F.lit(1)))
    rows = per.withColumn("next", F.lead("row").over(Window.partitionBy(*(by or [])).orderBy("row")))
    return rows.where(F.col("row") < scan).select(*(by or []), "row", F.when((F.col("width") >= 2) & (F.col("next") <= F.col("row") + BELOW), score).otherwise(0.0).alias("score"))


def header_row(grid: DataFrame, scan: int = SCANNED, by: list[str] | None = None) -> DataFrame:
    """One row, or one for each of ``by``: the header's ``row`` and ``score``. A later row must beat the best so far by the factor; a fold over at most ``scan`` scores."""
    scores = F.array_sort(F.collect_list(F.struct("row", "score")))
    start = F.struct(F.lit(0).cast("int").alias("row"), F.lit(0.0).alias("score"))

    def better(best: Column, x: Column) -> Column:
        return F.when(x["score"] > best["score"] * BETTER, F.struct(x["row"].cast("int").alias("row"), x["score"].alias("score"))).otherwise(best)

    return header_scores(grid, scan, by).groupBy(*(by or [])).agg(F.aggregate(scores, start, better).alias("b")).select(*(by or []), "b.*")


def table_blocks(grid: DataFrame, gap: int = GAP, by: list[str] | None = None) -> DataFrame:
    """``([by..], first_row, last_row)`` of the tables of a sheet, or of each of ``by``, split where ``gap`` or more rows are blank; two rows and columns at least."""
    by = by or []
    rows = grid.where(~is_blank(F.col("value"))).groupBy(*by, "row").agg(F.count("*").alias("width"))
    w = Window.partitionBy(*by).orderBy("row")
    cut = rows.withColumn("new", (F.col("row") - F.lag("row").over(w) > gap).cast("int")).withColumn("block", F.sum(F.coalesce("new", F.lit(0))).over(w))
    out = cut.groupBy(*by, "block").agg(F.min("row").alias("first_row"), F.max("row").alias("last_row"), F.count("*").alias("n"), F.max("width").alias("width"))
    return out.where("n >= 2 and width >= 2").select(*by, "first_row", "last_row")


def fill_merged(grid: DataFrame, ranges: DataFrame) -> DataFrame:
    """Every cell of the merged ``ranges(r0, c0, r1, c1)``, ends included and within the sheet, with the value of its first cell; ranges
    whose first cell is blank change nothing."""
    ends = grid.agg(F.max("row").alias("row"), F.max("col").alias("col")).first()
    heads = grid.where(~is_blank(F.col("value"))).select(F.col("row").alias("r0"), F.col("col").alias("c0"), F.col("value").alias("head"))
    within = {"r1": F.least("r1", F.lit(ends.row)), "c1": F.least("c1", F.lit(ends.col))}
    known = ranges.join(heads, ["r0", "c0"]).withColumns(within).where("r0 <= r1 and c0 <= c1")
    cells = known.select("head", "c0", "c1", F.explode(F.sequence("r0", "r1")).alias("row")).select("row", F.explode(F.sequence("c0", "c1")).alias("col"), F.col("head").alias("value"))
    return grid.join(cells.select("row", "col"), ["row", "col"], "left_anti").unionByName(cells)


def header_top(ranges: DataFrame, start: int) -> int:
    """The first row of the header block that ``start`` lies in: up along the ranges merged down across it, which are few."""
    rows = sorted((r.r0, r.r1) for r in ranges.select("r0", "r1").where("r1 > r0").distinct().collect())
    while above := [r0 for r0, r1 in rows if r0 < start <= r1]:
        start = min(above)
    return start


def header_depth(ranges: DataFrame, start: int) -> int:
    """How many rows the header that starts there takes, by the ranges merged down from it."""
    return ranges.where((F.col("r0") == start) & (F.col("r1") > start)).agg(F.coalesce(F.max(F.col("r1") - start + 1), F.lit(1)).alias("d")).first().d


def joined_header(grid: DataFrame, top: int, depth: int, glue: str = " - ") -> DataFrame:
    """``(col, name)``: the stacked header cells of each column from the top down, neighbouring repeats once."""
    cells = grid.where(F.col("row").between(top, top + depth - 1) & ~is_blank(F.col("value")))
    tiers = F.transform(F.array_sort(F.collect_list(F.struct("row", F.trim("value").alias("v")))), lambda c: c["v"])
    per = cells.groupBy("col").agg(tiers.alias("tiers"))
    changed = F.filter("tiers", lambda v, i: (i == 0) | (v != F.get(F.col("tiers"), F.greatest(i - 1, F.lit(0)))))
    return per.select("col", F.array_join(changed, glue).alias("name"))


def looks_merged(names: list[str], first_column: list[str | None], blank: set[str | None] = frozenset({None, ""})) -> bool:
    """If a sheet is worth a second reading for merged cells: an unnamed column right of a named one, on a sheet that is mostly named; or
    blanks under filled cells of the first column, two of them and a fifth of it."""
    unnamed = [n.strip().lower().startswith("unnamed") or not n.strip() for n in names]
    if 0 < sum(unnamed) < 0.5 * len(names) and any(b and not a for a, b in zip(unnamed, unnamed[1:])):
        return True
    gaps = sum(b in blank and a not in blank for a, b in zip(first_column, first_column[1:]))
    return len(first_column) >= 4 and gaps >= 2 and sum(v in blank for v in first_column) >= 0.2 * len(first_column)


def as_table(grid: DataFrame, names: list[str], first: int) -> DataFrame:
    """The rows below a header as columns of text, with ``_row``."""
    cols = [F.max(F.when(F.col("col") == i, F.col("value"))).alias(n) for i, n in enumerate(names)]
    return grid.where(F.col("row") >= first).groupBy(F.col("row").alias("_row")).agg(*cols)


def usability(df: DataFrame, place_column: str | None) -> DataFrame:
    """One row: why a sheet cannot be mapped, or "ok"."""
    unnamed = sum(c.lower().startswith("unnamed") for c in df.columns) / max(len(df.columns), 1)
    n = df.agg(F.count("*").alias("n_rows"))
    verdict = F.when(F.col("n_rows") == 0, "no-rows").when(F.lit(unnamed > 0.5), "unnamed-columns").when(F.lit(place_column is None), "no-place-column").otherwise("ok")
    return n.select("n_rows", verdict.alias("verdict"))
