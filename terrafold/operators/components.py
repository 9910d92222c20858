"""Connected components by repeated contraction, without hubs or components ever meeting in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import discard, merged_joins, stage


def components(links: DataFrame) -> DataFrame:
    """``links(u, v)`` (long, any order, repeats allowed) to ``(node, root)``: one root for each component, a member of it.

    Each round every node joins the neighbour with the smallest random priority (itself included) and the links are rewritten to
    what their ends joined; the expected number of rounds is logarithmic. A hub costs a partial minimum for each task and, on the
    join, what adaptive skew handling splits. Empty links give an empty table.
    """
    with merged_joins(links.sparkSession):
        return _contracted(links)


def _contracted(links: DataFrame) -> DataFrame:
    left = stage(links.select("u", "v").where("u <> v").distinct(), "links")
    steps: list[DataFrame] = []
    while not left.isEmpty():
        salt = F.lit(len(steps))
        rank = lambda c: F.struct(F.xxhash64(salt, c).alias("p"), c.alias("id"))
        both = left.union(left.select("v", "u"))
        hook = stage(
            both.groupBy("u").agg(F.min(rank(F.col("v"))).alias("m")).select("u", F.least(F.col("m"), rank(F.col("u")))["id"].alias("r")),
            "hook",
        )
        a, b = hook.select("u", F.col("r").alias("ru")), hook.select(F.col("u").alias("v"), F.col("r").alias("rv"))
        nxt = left.join(a, "u").join(b, "v").where("ru <> rv")
        nxt = stage(nxt.select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(), "links")
        discard(left)
        left = nxt
        steps.append(hook)
    if not steps:
        return left.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = steps[0].select(F.col("u").alias("node"), F.col("r").alias("root"))
    for k, hook in enumerate(steps[1:]):
        out = out.join(hook.select(F.col("u").alias("root"), F.col("r")), "root", "left").select("node", F.coalesce("r", "root").alias("root"))
        if k % 4 == 3:
            out = stage(out, "roots")
    out = stage(out, "roots")
    discard(left, *steps)
    return out
