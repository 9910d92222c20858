"""Combining rows of one place by the method each quantity deserves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .semantics import resolve_method

METHODS = ["sum", "mean", "median", "max", "min", "mode", "first", "weighted-mean"]


def weighted_mean(value: Column, weight: Column) -> Column:
    """Over rows with a value and a positive weight; without such a row the plain mean."""
    use = value.isNotNull() & (weight > 0)
    return F.coalesce(F.try_divide(F.sum(F.when(use, value * weight)), F.sum(F.when(use, weight))), F.avg(value))


def combine_column(method: str, value: Column, weight: Column | None = None, order: Column | None = None) -> Column:
    """The aggregate of a method. A group without values is null, not zero. Modes of equal count give the smallest value; ``first``
    needs the ``order`` of rows and skips nulls. ``recompute`` is the weighted mean."""
    method = "weighted-mean" if method == "recompute" else method
    if method == "weighted-mean" and weight is None:
        method = "mean"
    plain = {"sum": F.sum, "mean": F.avg, "median": F.median, "max": F.max, "min": F.min}
    if method in plain:
        return plain[method](value)
    if method == "mode":
        return F.mode(value, True)
    if method == "first":
        return F.min_by(F.when(value.isNotNull(), value), F.when(value.isNotNull(), order))
    if method == "weighted-mean":
        return weighted_mean(value, weight)
    raise ValueError(f"unknown method {method!r}; known: {', '.join(METHODS)}")


def combine(df: DataFrame, keys: list[str], column: str, method: str, weight: str | None = None, order: str | None = None, semantic: str = "unknown") -> DataFrame:
    """One row for each key with ``value`` and ``n_rows``; partial aggregates run before the one shuffle on the keys. ``auto`` is the
    method that the semantic deserves."""
    value = combine_column(resolve_method(method, semantic, weight is not None), F.col(column), F.col(weight) if weight else None, F.col(order) if order else None)
    return df.groupBy(*keys).agg(value.alias("value"), F.count("*").alias("n_rows"))


def combine_described(df: DataFrame, keys: list[str], described: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row for each key with every column (all that can be mapped, or those named) combined by the method that its values deserve, and
    ``n_rows``. ``described`` says the methods and weights; columns are few and come to the driver; all are combined in one shuffle.
    """
    told = {r.column: r for r in described.select("column", "mappable", "default_method", "weight_column").collect()}
    asked = [c for c in df.columns if c in told and told[c].mappable and c not in keys] if columns is None else columns
    unknown = [c for c in asked if c not in told]
    if unknown:
        raise ValueError(f"not described: {', '.join(unknown)}")
    values = []
    for c in asked:
        weight = told[c].weight_column
        method = "weighted-mean" if told[c].default_method == "recompute" else told[c].default_method
        values.append(combine_column(method, F.col(f"`{c}`"), F.col(f"`{weight}`") if weight else None).alias(c))
    return df.groupBy(*(F.col(f"`{k}`") for k in keys)).agg(*values, F.count("*").alias("n_rows"))


def period_filter(df: DataFrame, column: str, period: str) -> DataFrame:
    """The rows of one period, compared as text."""
    return df.where(F.col(column).cast("string") == period)


def with_change(df: DataFrame, baseline: str, comparison: str, name: str = "change") -> DataFrame:
    """``comparison`` minus ``baseline`` as a column of percentage points. ValueError on a column that isn't there: a period is no column."""
    for c in (baseline, comparison):
        if c not in df.columns:
            raise ValueError(f"no column {c!r}; there are {', '.join(df.columns)}")
    return df.withColumn(name, F.col(f"`{comparison}`") - F.col(f"`{baseline}`"))


def split_ratio(text: str) -> tuple[str, str | None]:
    """``A / B`` to its two columns; other texts to themselves and None. Blanks around the slash are needed, since headings hold slashes."""
    top, sign, bottom = text.partition(" / ")
    return (top.strip(), bottom.strip()) if sign and top.strip() and bottom.strip() else (text, None)


def wide_ratio(df: DataFrame, keys: list[str], text: str) -> DataFrame | None:
    """``A / B`` of two columns for each key, summed and then divided, times 100: `ratio_of_sums`. None where the text is no ratio."""
    top, bottom = split_ratio(text)
    if bottom is None:
        return None
    for c in (top, bottom):
        if c not in df.columns:
            raise ValueError(f"no column {c!r}; there are {', '.join(df.columns)}")
    return ratio_of_sums(df, keys, F.col(f"`{top}`"), F.col(f"`{bottom}`"))


def duplicate_count(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many keys have several rows."""
    return df.groupBy(*keys).count().where("count > 1").agg(F.count("*").alias("duplicated_keys"))


def ratio_of_sums(df: DataFrame, keys: list[str], top: Column, bottom: Column, scale: float = 100.0) -> DataFrame:
    """Sum, then divide: ``numerator``, ``denominator`` and ``ratio`` for each key; a zero denominator gives no ratio."""
    sums = df.groupBy(*keys).agg(F.sum(top).alias("numerator"), F.sum(bottom).alias("denominator"))
    return sums.withColumn("ratio", F.when(F.col("denominator") != 0, F.col("numerator") / F.col("denominator") * scale))


def spread(df: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """A keyed aggregate put back on the rows."""
    return df.join(totals, keys, "left")


def profile_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each column: missing share, distinct texts, and for numbers min, median, max and total, in one pass each side.

    The median is the exact upper one; distinct counts run on the unpivoted texts, so one shuffle serves all columns.
    """
    kinds = dict(df.dtypes)
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("text"), (F.col(c).cast("double") if kinds[c] not in ("string", "timestamp", "date", "boolean") else F.lit(None).cast("double")).alias("number")) for c in columns]
    long = df.select(F.explode(F.array(*pairs)).alias("r")).select("r.*")
    per_text = long.groupBy("column", "text", "number").agg(F.count("*").alias("n"))
    stats = per_text.groupBy("column").agg(
        F.sum("n").alias("rows"), (F.sum(F.when(F.col("text").isNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("missing"), F.countDistinct("text").alias("distinct_values"),
        F.min("number").alias("min"), F.max("number").alias("max"), F.sum(F.col("number") * F.col("n")).alias("total"),
    )
    return stats


def upper_median(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The element at n div 2 of the sorted values: an observed value, never a mean of two. Equal values are counted before the
    window, so it sees the distinct ones."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    run = counts.withColumn("upto", F.sum("n").over(w.orderBy(column))).withColumn("of", F.sum("n").over(w))
    return run.where(F.col("upto") > F.floor(F.col("of") / 2)).groupBy(*keys).agg(F.min(column).alias("upper_median"))
