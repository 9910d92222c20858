"""Exact ranks and bounded lists of the commonest values for many groups at once, without a group ever meeting in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pivots of a round for each group, and distinct values that are looked at one by one.
PIVOTS, FEW = 64, 512


def ranked_values(counts: DataFrame, ranks: DataFrame) -> dict[str, float]:
    """``counts(column, v, n)``, staged, a row or two for each column and value, and ``ranks(column, rank)`` to the value of that rank (from 0, each
    value n times) in each column. Columns are few: a window, and a rank in it, for each of them is on the driver.

    Each round cuts every column's window at approximate quantiles of its distinct values and counts what lies between; the part that
    holds the rank is the next window, until few values are left in it. Counts combine before the shuffle. A round that cannot
    narrow a window halves it by value, so the rounds end.
    """
    spark = counts.sparkSession
    live = counts.where("v is not null")
    windows = {r.column: (None, None, r.rank) for r in ranks.collect() if r.rank is not None}
    found: dict[str, float] = {}
    while windows:
        rows = [(c, lo, hi) for c, (lo, hi, _) in windows.items()]
        window = F.broadcast(spark.createDataFrame(rows, "column string, lo double, hi double"))
        inside = (F.col("lo").isNull() | (F.col("v") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("v") <= F.col("hi")))
        mine = live.join(window, "column").where(inside)
        quantiles = F.percentile_approx("v", [k / PIVOTS for k in range(1, PIVOTS)], 10 * PIVOTS)
        told = mine.groupBy("column").agg(F.count("*").alias("k"), quantiles.alias("q"), F.min("v").alias("a"), F.max("v").alias("b")).collect()
        few = [r.column for r in told if r.k <= FEW]
        if few:
            lists = mine.where(F.col("column").isin(few)).groupBy("column").agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("vs"))
            for r in lists.collect():
                left = windows.pop(r.column)[2]
                for x in r.vs:
                    if left < x.n:
                        found[r.column] = x.v
                        break
                    left -= x.n
        cuts = {}
        for r in told:
            if r.column not in few:
                inner = sorted({q for q in r.q if r.a <= q < r.b})
                cuts[r.column] = inner or [r.a + (r.b - r.a) / 2]
        windows = {c: w for c, w in windows.items() if c in cuts}
        if not cuts:
            break
        pivots = F.broadcast(spark.createDataFrame(list(cuts.items()), "column string, at array<double>"))
        part = F.size(F.filter("at", lambda p: F.col("v") > p)).alias("part")
        sizes: dict[str, dict[int, int]] = {}
        for r in mine.join(pivots, "column").select("column", part, "n").groupBy("column", "part").agg(F.sum("n").alias("n")).collect():
            sizes.setdefault(r.column, {})[r.part] = r.n
        for c, at in cuts.items():
            lo, hi, left = windows[c]
            for part_, n in sorted(sizes[c].items()):
                if left < n:
                    windows[c] = (at[part_ - 1] if part_ else lo, at[part_] if part_ < len(at) else hi, left)
                    break
                left -= n
    return found


def commonest(counts: DataFrame, most: int) -> dict[str, list[str]]:
    """``counts(column, text, n)``, distinct by column and text, to the ``most`` commonest texts of each column, ties by text: each batch of
    rows keeps as many for each column, and so does the aggregation of what is left, so nothing is shuffled but a few texts for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for b in batches:
            best = first(b if best is None else pa.Table.from_batches([best, b]).combine_chunks().to_batches()[0])
        if best is not None:
            yield best

    def first(b: pa.RecordBatch) -> pa.RecordBatch:
        if not b.num_rows:
            return b
        ordered = b.take(pc.sort_indices(b, sort_keys=[("column", "ascending"), ("n", "descending"), ("text", "ascending")]))
        codes = ordered.column(0).dictionary_encode().indices.to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
        place = np.arange(len(codes)) - np.repeat(starts, np.diff([*starts, len(codes)]))
        return ordered.take(pa.array(np.flatnonzero(place < most)))

    rows = counts.where("text is not null").select("column", "text", "n").mapInArrow(run, "column string, text string, n long")
    lists = rows.groupBy("column").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "text"))), 1, most)["text"].alias("texts"))
    return {r.column: list(r.texts) for r in lists.collect()}
