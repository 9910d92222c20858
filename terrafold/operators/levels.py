"""Boxes of any size met through an index of square cells on several levels: each box in cells of its own size's level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def box_level(box: Column) -> Column:
    """The power of two that is as long as the longer side of a ``bounds`` or longer; a point has the lowest level, -60."""
    side = F.greatest(box["x1"] - box["x0"], box["y1"] - box["y0"])
    return F.when(side > 0, F.greatest(F.ceil(F.log2(side)).cast("int"), F.lit(-60))).otherwise(F.lit(-60))


def _cells(box: Column, level: Column, name: str) -> list[Column]:
    size = F.pow(F.lit(2.0), level)
    span = lambda k: F.sequence(F.floor(box[f"{k}0"] / size).cast("long"), F.floor(box[f"{k}1"] / size).cast("long"))
    return F.explode(F.flatten(F.transform(span("x"), lambda x: F.transform(span("y"), lambda y: F.struct(x.alias("x"), y.alias("y")))))).alias(name)


def meeting(a: DataFrame, b: DataFrame, also: Column | None = None) -> DataFrame:
    """``a(a_id, a_box, ..)`` and ``b(b_id, b_box, ..)`` to pairs of rows whose boxes touch, each pair once, all columns of both. ``also`` is a
    further condition of the join.

    A box lies in at most four cells of its own level. Two boxes meet on the level of the larger one, where the smaller one lies in at
    most four cells too; so a box is dealt to its own level and, on the other side, to each level in use above it. Levels in use are as
    few as the sizes' powers of two, so rows grow with the boxes, however much their sizes differ. What is dealt is what the caller
    sends: ids and boxes, not outlines. Of the cells that both lie in, the one that holds the lower left corner of the overlap speaks.
    """
    touch = lambda p, q: (p["x0"] <= q["x1"]) & (q["x0"] <= p["x1"]) & (p["y0"] <= q["y1"]) & (q["y0"] <= p["y1"])
    a, b = (df.withColumn(f"{s}_level", box_level(F.col(f"{s}_box"))) for df, s in ((a, "a"), (b, "b")))
    levels = sorted(r.l for r in a.select(F.col("a_level").alias("l")).union(b.select("b_level")).distinct().collect())

    def dealt(df: DataFrame, side: str, own: bool) -> DataFrame:
        """To the own level, or to all in use above it."""
        if own:
            df = df.withColumn("level", F.col(f"{side}_level"))
        else:
            df = df.withColumn("level", F.explode(F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda l: l > F.col(f"{side}_level"))))
        return df.select("*", _cells(F.col(f"{side}_box"), F.col("level"), "cell"))

    def met(x: DataFrame, y: DataFrame) -> DataFrame:
        p, q, size = F.col("a_box"), F.col("b_box"), F.pow(F.lit(2.0), F.col("level"))
        corner = F.struct(*(F.floor(F.greatest(p[f"{k}0"], q[f"{k}0"]) / size).cast("long").alias(k) for k in "xy"))
        out = x.join(y, ["level", "cell"]).where(touch(p, q) & (F.col("cell") == corner) & (F.lit(True) if also is None else also))
        return out.select(*(c for c in (*a.columns, *b.columns) if c not in ("a_level", "b_level")))

    same_or_above = met(dealt(a, "a", True), dealt(b, "b", True)).union(met(dealt(a, "a", True), dealt(b, "b", False)))
    return same_or_above.union(met(dealt(a, "a", False), dealt(b, "b", True)))
