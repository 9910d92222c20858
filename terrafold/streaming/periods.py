"""Sums by period of rows that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def period_sums(rows: DataFrame, key: str, time: str, value: str, every: str = "1 day", late: str = "2 days") -> DataFrame:
    """``(start, key, total, n_rows)`` for each period and key of a stream or a table. Rows later than ``late`` behind the newest are
    dropped by the watermark, which also bounds the state; rows without a time belong to no period."""
    timed = rows.withColumn(time, F.col(time).cast("timestamp"))
    window = F.window(time, every)
    sums = timed.withWatermark(time, late).groupBy(window.alias("w"), key).agg(F.sum(value).alias("total"), F.count("*").alias("n_rows"))
    return sums.select(F.col("w.start").alias("start"), key, "total", "n_rows")
