"""Statistical safety checks: each gives the issues it finds as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.periods import granularity
from .classify import Bins

SEVERITIES = ["critical", "warning", "info"]
NEVER_SUM = {"percent", "rate-per-capita", "percentage-point", "ratio", "score"}


def issue(df: DataFrame, key: str, severity: Column | str, found: Column, metric: Column, column: str = "") -> DataFrame:
    """``(id, severity, column, metric)`` for the rows of ``df`` (of aggregates) where ``found`` holds."""
    level = F.lit(severity) if isinstance(severity, str) else severity
    return df.where(found).select(F.lit(key).alias("id"), level.alias("severity"), F.lit(column).alias("column"), metric.cast("double").alias("metric"))


def ranked(issues: list[DataFrame]) -> DataFrame:
    """All issues with ``rank``: critical, warning, info."""
    out = issues[0]
    for more in issues[1:]:
        out = out.unionByName(more)
    return out.withColumn("rank", F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")))


def check_coverage(frame: DataFrame, value: str) -> DataFrame:
    share = F.count(value) / F.count("*")
    return issue(frame.agg(share.alias("share")), "low-coverage", F.when(F.col("share") < 0.15, "critical").otherwise("warning"), F.col("share") < 0.35, F.col("share"), value)


def check_aggregation(df: DataFrame, keys: list[str], column: str, semantic: str, method: str, weighted: bool = False, basis: str = "guessed") -> list[DataFrame]:
    """What combining duplicates does to a quantity: a rate summed, averaged without a weight, or with a weight that was guessed."""
    n = df.groupBy(*keys).count().agg(F.count_if(F.col("count") > 1).alias("n"))
    never = semantic in NEVER_SUM
    some = F.col("n") > 0
    return [
        issue(n, "summing-a-rate", "critical", some & F.lit(never and method == "sum"), F.col("n"), column),
        issue(n, "unweighted-mean", "warning", some & F.lit(never and (method == "mean" or method == "weighted-mean" and not weighted)), F.col("n"), column),
        issue(n, "weight-guessed", "warning", some & F.lit(method == "weighted-mean" and weighted and basis == "guessed"), F.col("n"), column),
    ]


def check_percent_range(df: DataFrame, column: str, scale: float = 1.0) -> list[DataFrame]:
    s = df.agg(F.max(F.col(column) * scale).alias("hi"), F.min(F.col(column) * scale).alias("lo"))
    return [issue(s, "percent-over-100", "warning", F.col("hi") > 100.5, F.col("hi"), column), issue(s, "percent-negative", "warning", F.col("lo") < 0, F.col("lo"), column)]


def check_diverging(df: DataFrame, column: str) -> DataFrame:
    s = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    return issue(s, "needs-diverging-scale", "info", (F.col("lo") < 0) & (F.col("hi") > 0), F.col("lo"), column)


def check_colour_choice(df: DataFrame, column: str, semantic: str, map_type: str) -> DataFrame:
    return issue(df.agg(F.count(column).alias("n")), "colour-by-count", "warning", F.lit(map_type == "choropleth" and semantic in ("count", "money")), F.col("n"), column)


def check_classes(df: DataFrame, column: str, bins: Bins) -> list[DataFrame]:
    n = df.agg(F.count(column).alias("n"))
    span, top = bins.edges[-1] - bins.edges[0], max(abs(bins.edges[0]), abs(bins.edges[-1]))
    flat = span / top if top else 0.0
    return [
        issue(n, "classes-adjusted", "info", F.lit(bool({"fewer-classes", "classes-merged"} & set(bins.notes))), F.lit(bins.classes), column),
        issue(n, "too-many-classes", "warning", F.lit(bins.classes) > F.greatest(F.lit(2), F.floor(F.col("n") / 3)), F.lit(bins.classes), column),
        issue(n, "spread-too-small", "warning", F.lit(flat <= 0.02), F.lit(flat), column),
    ]


def check_matching(summary: DataFrame) -> list[DataFrame]:
    """From the one-row summary of a review."""
    def one(key: str, severity: str, column: str) -> DataFrame:
        return issue(summary, key, severity, F.col(column) > 0, F.col(column))

    return [one("unmatched-rows", "critical", "unmatched"), one("merger-converted", "info", "by_merged"), one("ambiguous-match", "critical", "by_ambiguous"), one("match-needs-review", "warning", "by_fuzzy")]


def check_admin_level(summary: DataFrame) -> DataFrame:
    share = (F.col("unmatched") + F.col("by_fuzzy")) / F.col("total")
    return issue(summary, "may-not-be-commune-level", "critical", (F.col("total") >= 10) & (share >= 0.15), share)


def check_periods(df: DataFrame, column: str) -> DataFrame:
    n = df.agg(F.countDistinct(column).alias("n"))
    return issue(n, "several-periods", "critical", F.col("n") > 1, F.col("n"), column)


def check_unreadable_periods(df: DataFrame, column: str, told: str | None = None) -> DataFrame:
    """Distinct periods that no rule reads; they sort last. ``told`` is what the issue calls the column."""
    return issue(granularity(df, column), "unreadable-periods", "warning", F.col("unreadable") > 0, F.col("unreadable"), told or column)


def check_double_count(axes: DataFrame) -> DataFrame:
    """From `double_counting_axes`: an issue for each axis on which a place has several rows of one indicator."""
    return axes.select(F.lit("long-table-double-count").alias("id"), F.lit("critical").alias("severity"), F.col("axis").alias("column"), F.col("places").cast("double").alias("metric"))


def check_sheet(usability: DataFrame) -> DataFrame:
    """From the one-row verdict on a sheet."""
    return issue(usability, "sheet-not-mappable", "critical", F.col("verdict") != "ok", F.col("n_rows"))


def check_category_order(ordered: DataFrame, stated: bool = False) -> DataFrame:
    """From `category_order`."""
    s = ordered.agg(F.count("*").alias("n"), F.bool_or("known").alias("known"))
    return issue(s, "categories-not-ordered", "warning", (F.col("n") >= 3) & ~F.coalesce("known", F.lit(False)) & F.lit(not stated), F.col("n"))


def check_occlusion(widths: DataFrame, width: str, most_radius: float) -> DataFrame:
    s = widths.agg(F.median(width).alias("w"))
    return issue(s, "circles-hide-areas", "warning", F.lit(2 * most_radius) > 1.6 * F.col("w"), F.lit(2 * most_radius) / F.col("w"), width)


def check_labels(units: DataFrame, most_labels: int = 45) -> DataFrame:
    s = units.agg(F.count("*").alias("n")).withColumn("share", F.least(F.lit(most_labels), F.col("n")) / F.col("n"))
    return issue(s, "few-labels", F.when(F.col("share") < 0.25, "critical").otherwise("warning"), F.col("share") < 0.6, F.col("share"))


def check_detached(masses: DataFrame) -> DataFrame:
    """From one row with ``main_width_share`` of a country drawn without an inset."""
    s = F.col("main_width_share")
    return issue(masses, "detached-land-no-inset", F.when(s < 0.5, "critical").otherwise("warning"), s < 0.8, s)


def check_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    shares = df.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns))
    long = shares.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("share")) for c in columns))).alias("r")).select("r.*")
    return long.where("share >= 0.4").select(F.lit("mostly-missing").alias("id"), F.lit("warning").alias("severity"), "column", F.col("share").alias("metric"))
