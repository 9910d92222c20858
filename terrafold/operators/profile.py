"""Profile of a data set: what its columns can show, as rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import headings as hd
from ..functions.text import normalize
from ..staging import stage
from .semantics import column_facts, denominators, with_semantics

# Parts of headings of denominators and of outcomes.
BACKGROUND = ["dan so", "quan the", "uoc tinh", "chi tieu", "muc tieu", "du dieu kien", "dang quan ly", "tong so ho"]
OUTCOMES = ["ca ", "ca_", "mac", "tu vong", "phat hien", "nhiem", "dieu tri"]
# Points of each kind of map.
POINTS = {"choropleth-symbol": 100, "choropleth": 88, "graduated-symbol": 84, "graduated-symbol-beside-rate": 70, "change": 80, "categorized": 74, "point": 72, "boundary": 40}


def described(df: DataFrame) -> DataFrame:
    """A row for each column, in order: facts, semantics, share of missing cells, and for rates the weight and its basis."""
    facts = stage(with_semantics(column_facts(df)), "column-facts")  # a row for each column, read several times
    weights = denominators(df, facts).select(F.col("rate").alias("column"), F.col("denominator").alias("weight_column"), F.col("basis").alias("weight_basis"))
    place = F.array_position(F.array(*map(F.lit, df.columns)), F.col("column"))
    out = facts.join(weights, "column", "left").withColumn("position", place.cast("int"))
    return out.withColumn("missing", 1 - F.try_divide(F.col("present"), F.col("n_rows")))


def coordinates(columns: DataFrame) -> DataFrame:
    """One row ``(lon, lat)``: the first column of either axis, null without one."""
    first = lambda axis: F.min_by(F.when(F.col("axis") == axis, F.col("column")), F.when(F.col("axis") == axis, F.col("position")))
    return columns.agg(first("lon").alias("lon"), first("lat").alias("lat"))


def valid_points(df: DataFrame, lon: str, lat: str) -> tuple[DataFrame, DataFrame]:
    """The rows with both coordinates, and one row: how many are drawn and skipped."""
    both = F.col(lon).isNotNull() & F.col(lat).isNotNull()
    return df.where(both), df.agg(F.count_if(both).alias("drawn"), F.count_if(~both).alias("skipped"))


def symbol_rank(columns: DataFrame) -> Column:
    """How little a count suits circles: denominators and money come late, outcomes early."""
    name = F.concat(hd.plain(F.col("column")), F.lit(" "))
    holds = lambda words: name.rlike("|".join(words))
    return F.when(holds(BACKGROUND), 5).otherwise(0) + F.when(F.col("semantic") == "money", 3).otherwise(0) - F.when(holds(OUTCOMES), 2).otherwise(0)


def map_options(columns: DataFrame) -> DataFrame:
    """``(kind, points, fill_by, symbol_by)``: the maps that the columns of `described` allow, best first by points; a boundary map where
    nothing else is."""
    first = lambda cond, order: F.min_by(F.when(cond, F.col("column")), F.when(cond, order))
    s, at = F.col("semantic"), F.struct("position")
    c = columns.withColumn("suits", symbol_rank(columns)).agg(
        first(s.isin("percent", "rate-per-capita"), at).alias("rate"), first(s.isin("count", "money"), F.struct("suits", "position")).alias("count"), first(s == "percentage-point", at).alias("change"),
        first((s == "category") & F.col("distinct_values").between(2, 8), at).alias("category"), first(F.col("axis") == "lon", at).alias("lon"), first(F.col("axis") == "lat", at).alias("lat"),
    )
    rate, count, none = F.col("rate"), F.col("count"), F.lit(None).cast("string")

    def option(kind: str, points: Column, cond: Column, fill: Column, symbol: Column) -> Column:
        return F.when(cond, F.struct(F.lit(kind).alias("kind"), points.alias("points"), fill.alias("fill_by"), symbol.alias("symbol_by")))

    p = lambda kind: F.lit(POINTS[kind])
    found = F.array_compact(F.array(
        option("choropleth-symbol", p("choropleth-symbol"), rate.isNotNull() & count.isNotNull(), rate, count), option("choropleth", p("choropleth"), rate.isNotNull(), rate, none),
        option("graduated-symbol", F.when(rate.isNull(), POINTS["graduated-symbol"]).otherwise(POINTS["graduated-symbol-beside-rate"]), count.isNotNull(), none, count),
        option("change", p("change"), F.col("change").isNotNull(), F.col("change"), none), option("categorized", p("categorized"), F.col("category").isNotNull(), F.col("category"), none),
        option("point", p("point"), F.col("lon").isNotNull() & F.col("lat").isNotNull(), none, none),
    ))
    nothing = F.array(F.struct(F.lit("boundary").alias("kind"), p("boundary").alias("points"), none.alias("fill_by"), none.alias("symbol_by")))
    return c.select(F.explode(F.when(F.size(found) > 0, found).otherwise(nothing)).alias("o")).select("o.*")


def year_pairs(columns: DataFrame) -> DataFrame:
    """``(indicator, baseline, comparison)``: mappable columns whose headings differ by a year only; the first and the last of them."""
    year = F.regexp_extract("column", r"(19|20)[0-9]{2}", 0)
    stem = F.lower(F.regexp_replace(F.regexp_replace("column", r"^(.*?)(19|20)[0-9]{2}", "$1"), r"^[ \-–_()]+|[ \-–_()]+$", ""))
    dated = columns.where((year != "") & F.col("mappable") & (F.col("semantic") != "category")).select(stem.alias("indicator"), year.alias("year"), "column")
    out = dated.groupBy("indicator").agg(F.min_by("column", F.struct("year", "column")).alias("baseline"), F.max_by("column", F.struct("year", "column")).alias("comparison"), F.count("*").alias("n"))
    return out.where("n > 1").drop("n")


# Semantics whose columns can't hold places; the least part of a column's cells that name a tier's units.
NO_PLACES, LEAST_PLACES = ["count", "percent", "rate-per-capita", "money", "percentage-point", "coordinate"], 0.35


def place_candidates(df: DataFrame, columns: list[str], provinces: DataFrame, communes: DataFrame | None, affixes: str) -> DataFrame:
    """``(tier, rank, column, match_rate, distinct_values)``: the columns that name units of either tier (``provinces(key)``,
    ``communes(key)``) in a good part of their filled cells, the best first.

    A column of one repeated value is the last to be the fine tier's; of equal rates the one with more distinct names comes first, then the
    one that stands first. Cells are counted by column and name before they meet the units; ranks are of a tier's columns, which are few.
    """
    if not columns:
        return df.sparkSession.createDataFrame([], "tier string, rank int, column string, match_rate double, distinct_values long")
    cell = lambda k, c: F.struct(F.lit(k).alias("at"), F.lit(c).alias("column"), normalize(F.col(f"`{c}`").cast("string"), affixes).alias("key"))
    cells = df.select(F.explode(F.array(*(F.when(F.col(f"`{c}`").isNotNull(), cell(k, c)) for k, c in enumerate(columns)))).alias("r")).where("r is not null").select("r.*")
    tiers = provinces.select("key", F.lit("province").alias("tier"))
    if communes is not None:
        tiers = tiers.unionByName(communes.select("key", F.lit("commune").alias("tier")))
    known = tiers.groupBy("key").agg(F.collect_set("tier").alias("tiers"))  # two at most
    counted = cells.groupBy("at", "column", "key").agg(F.count("*").alias("n")).join(known, "key", "left")
    hit = lambda tier: F.sum(F.when(F.array_contains("tiers", tier), F.col("n")).otherwise(0)) / F.sum("n")
    shares = counted.groupBy("at", "column").agg(hit("province").alias("province"), hit("commune").alias("commune"), F.count("*").alias("distinct_values"))
    each = F.array(*(F.struct(F.lit(t).alias("tier"), F.col(t).alias("match_rate")) for t in ("province", "commune")))
    found = shares.select("at", "column", "distinct_values", F.explode(each).alias("t")).select("at", "column", "distinct_values", "t.*").where(F.col("match_rate") >= LEAST_PLACES)
    repeated = (F.col("tier") == "commune") & (F.col("distinct_values") < 2)
    rank = F.row_number().over(Window.partitionBy("tier").orderBy(repeated, F.desc("match_rate"), F.desc("distinct_values"), "at"))
    return found.select("tier", rank.alias("rank"), "column", "match_rate", "distinct_values")


def quality_warnings(columns: DataFrame) -> DataFrame:
    """``(id, severity, column, metric)`` of what the columns of `described` give cause for: several periods, percentages beyond 0 and 100,
    mostly missing cells. Facts alone are read, no cell again."""
    s, hundred = F.col("semantic"), F.when(F.col("scale") == "unit", 100.0).otherwise(1.0)

    def warn(key: str, severity: str, cond: Column, metric: Column) -> Column:
        return F.when(cond, F.struct(F.lit(key).alias("id"), F.lit(severity).alias("severity"), F.col("column"), metric.cast("double").alias("metric")))

    high, low = F.col("hi") * hundred, F.col("lo") * hundred
    found = F.array_compact(F.array(
        warn("several-periods", "critical", (s == "time") & (F.col("distinct_values") > 1), F.col("distinct_values")), warn("percent-over-100", "warning", (s == "percent") & (high > 100.5), high),
        warn("percent-negative", "warning", (s == "percent") & (low < 0), low), warn("mostly-missing", "warning", (F.col("missing") >= 0.4) & F.col("mappable"), F.col("missing")),
    ))
    return columns.select(F.explode(found).alias("w")).select("w.*")


@dataclass
class Profile:
    """What a table holds: a row for each column; columns of places and the finest tier that they allow; axes of coordinates; columns of
    periods, pairs of years, maps that can be drawn, warnings. ``columns`` is staged, the rest but ``places`` is read off it."""

    columns: DataFrame
    places: DataFrame
    coordinates: DataFrame
    periods: DataFrame
    year_pairs: DataFrame
    options: DataFrame
    warnings: DataFrame

    def summary(self) -> DataFrame:
        """``(part, item, detail)``: all of it as rows."""
        none = F.lit(None).cast("string")
        axes = F.array(*(F.struct(F.lit(a).alias("axis"), F.col(a).alias("column")) for a in ("lon", "lat")))
        part = lambda name, df, item, detail: df.select(F.lit(name).alias("part"), item.alias("item"), detail.cast("string").alias("detail"))
        parts = [
            part("column", self.columns, F.col("column"), F.col("semantic")), part("weight", self.columns.where("weight_column is not null"), F.col("column"), F.col("weight_column")),
            part("place", self.places, F.col("column"), F.concat_ws(" ", "tier", "rank")), part("coordinate", self.coordinates.select(F.explode(axes).alias("a")).where("a.column is not null"), F.col("a.column"), F.col("a.axis")),
            part("period", self.periods, F.col("column"), none), part("years", self.year_pairs, F.col("indicator"), F.concat_ws(" - ", "baseline", "comparison")),
            part("option", self.options, F.col("kind"), F.col("points")), part("warning", self.warnings, F.col("column"), F.col("id")),
        ]
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more)
        return out


def profile(df: DataFrame, provinces: DataFrame, communes: DataFrame | None, affixes: str) -> Profile:
    """The `Profile` of a table against the names of the units of both tiers (``provinces(key)``, ``communes(key)``, normalised)."""
    columns = stage(described(df), "profile-columns")
    maybe = [r.column for r in columns.where(~F.col("semantic").isin(NO_PLACES)).orderBy("position").select("column").collect()]
    places = stage(place_candidates(df, maybe, provinces, communes, affixes), "profile-places")
    periods = columns.where("semantic = 'time'").select("column", "distinct_values")
    return Profile(columns, places, coordinates(columns), periods, year_pairs(columns), map_options(columns), quality_warnings(columns))


def sample(df: DataFrame, first: list[str], columns: int = 7, rows: int = 5, order: str | None = None) -> DataFrame:
    """A few rows of a few columns to show: those named come first; rows by ``order`` where one is named."""
    shown = [*dict.fromkeys(c for c in [*first, *df.columns] if c in df.columns)][:columns]
    return (df.orderBy(order) if order else df).select(*shown).limit(rows)


def top_indicators(slices: DataFrame, most: int = 12) -> DataFrame:
    """The indicators with the most places, then rows, then by name, with their ``rank``; the window sees one row an indicator."""
    rank = F.row_number().over(Window.orderBy(F.desc("places"), F.desc("n_rows"), "indicator"))
    return slices.withColumn("rank", rank).where(F.col("rank") <= most)
