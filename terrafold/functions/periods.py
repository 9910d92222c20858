"""Reporting periods written as people write them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import deaccent

#: From fine to coarse.
GRANULARITIES = ["day", "month", "quarter", "year"]
UNREAD = (9999, 99, 99)


def parse_period(c: Column) -> Column:
    """struct<y, m, d, granularity> or null: a date, a quarter (its first month), a month or a year found in the text, in this
    order. Quarters may be Roman or Arabic, after q, qu or quy."""
    text = F.trim(deaccent(c.cast("string")))

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(text, pattern, group)

    def found(y: Column, m: Column, d: Column, kind: str) -> Column:
        return F.struct(y.cast("int").alias("y"), m.cast("int").alias("m"), d.cast("int").alias("d"), F.lit(kind).alias("granularity"))

    date = r"(\d{4})[-/](\d{1,2})[-/](\d{1,2})"
    quarter = r"q(?:uy?)?\s*([1-4]|iv|i{1,3})\s*[/\- ]\s*(\d{4})"
    named = r"\b(?:thang|t)\s*(0?[1-9]|1[0-2])\s*[/\- ]\s*(\d{4})"
    year_month = r"(\d{4})[-/](0?[1-9]|1[0-2])(?:\D|$)"
    month_year = r"(?:^|\D)(0?[1-9]|1[0-2])[/-](\d{4})(?:\D|$)"
    year = r"(?:^|\D)((?:19|20)\d{2})(?:\D|$)"
    q = part(quarter, 1)
    first = (F.when(q == "iv", 4).when(q.startswith("i"), F.length(q)).otherwise(q.try_cast("int")) - 1) * 3 + 1
    one = F.lit(1)
    return (
        F.when(text.rlike(date), found(part(date, 1), part(date, 2), part(date, 3), "day"))
        .when(text.rlike(quarter), found(part(quarter, 2), first, one, "quarter"))
        .when(text.rlike(named), found(part(named, 2), part(named, 1), one, "month"))
        .when(text.rlike(year_month), found(part(year_month, 1), part(year_month, 2), one, "month"))
        .when(text.rlike(month_year), found(part(month_year, 2), part(month_year, 1), one, "month"))
        .when(text.rlike(year), found(part(year, 1), one, one, "year"))
    )


def period_key(c: Column) -> Column:
    """What periods sort by: date parts, unreadable ones last, then the text."""
    p = parse_period(c)
    y, m, d = (F.coalesce(p[k], F.lit(x)).alias(k) for k, x in zip("ymd", UNREAD))
    return F.struct(y, m, d, c.cast("string").alias("text"))


def ordered_periods(df: DataFrame, column: str) -> DataFrame:
    """``(period, ord)``: the distinct periods in chronological order, from 0. Few against the rows: one sort of the distinct ones."""
    text = F.trim(F.col(column).cast("string"))
    seen = df.select(text.alias("period")).where((F.col("period") != "") & ~F.lower("period").isin("nan", "none", "nat")).distinct()
    return seen.withColumn("ord", F.row_number().over(Window.orderBy(period_key(F.col("period")))) - 1)


def granularity(df: DataFrame, column: str) -> DataFrame:
    """One row: the finest granularity of the readable periods, else "unknown", and how many distinct ones are unreadable."""
    seen = df.select(F.col(column).cast("string").alias("p")).where("p is not null").distinct().select(parse_period(F.col("p"))["granularity"].alias("g"))
    finest = F.lit("unknown")
    for kind in reversed(GRANULARITIES):
        finest = F.when(F.max((F.col("g") == kind).cast("int")) == 1, kind).otherwise(finest)
    return seen.agg(finest.alias("granularity"), F.count_if(F.col("g").isNull()).alias("unreadable"))


def latest_period(df: DataFrame, by: list[str], column: str, place: str, value: str) -> DataFrame:
    """The last period of each slice in chronological order, with its places and total."""
    per = df.groupBy(*by, F.col(column).cast("string").alias("period")).agg(F.countDistinct(place).alias("places"), F.sum(value).alias("total"))
    best = F.max_by(F.struct("period", "places", "total"), period_key(F.col("period")))
    return per.groupBy(*by).agg(best.alias("b")).select(*by, "b.*")
