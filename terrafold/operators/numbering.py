"""Row numbers over a whole table, in order, without all rows meeting in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage

#: Rows that one range holds, about.
RANGE_ROWS = 100_000


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with ``name``, each row's place from 0 in the ascending order of the columns ``order`` (nulls first), which should tell rows apart.

    Rows are dealt to ranges and numbered there; how many rows the ranges before have is a number for each range. The dealt rows are
    written, since ranges come from a sample and are read twice. Empty input: no rows.
    """
    rows = stage(df, "rows")
    parts = max(1, rows.count() // RANGE_ROWS)
    dealt = stage(rows.repartitionByRange(parts, *order).withColumn("range_", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("range_").agg(F.count("*").alias("n"))
    before = sizes.select("range_", (F.sum("n").over(Window.orderBy("range_")) - F.col("n")).alias("before_"))
    place = F.row_number().over(Window.partitionBy("range_").orderBy(*order)) - 1
    return dealt.withColumn(name, place).join(F.broadcast(before), "range_").withColumn(name, (F.col(name) + F.col("before_")).cast("int")).drop("range_", "before_")
