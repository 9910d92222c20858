"""Natural breaks, blends and streams against brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.functions.numbers import blend, nice_length
from terrafold.operators import breaks
from terrafold.operators import classify as cl
from terrafold.operators.breaks import natural_breaks
from terrafold.queries import QUERIES
from terrafold.streaming.periods import period_sums
from tests.support import SF


@pytest.mark.parametrize("values, k", [([1, 2, 2, 3, 10, 11, 30], 3), ([5, 5, 5, 9], 2), ([0.5, 1.5, 7, 7.5, 8, 20, 21, 40, 41], 4), ([1, 2, 3, 4], 4)])
def test_natural_breaks(spark, values, k):
    data = spark.createDataFrame([(float(v),) for v in values], "v double")
    distinct = sorted(set(map(float, values)))

    def cost(ends):
        total, low = 0.0, float("-inf")
        for end in ends:
            own = [v for v in values if low < v <= end]
            mean = sum(own) / len(own)
            total, low = total + sum((v - mean) ** 2 for v in own), end
        return total

    best = min(cost([*cut, distinct[-1]]) for cut in itertools.combinations(distinct[:-1], k - 1))
    ends = natural_breaks(data, k)
    assert len(ends) == k and ends[-1] == distinct[-1] and cost(ends) == pytest.approx(best)


def plain_breaks(values, k):
    """Fisher's division, every split of every end tried."""
    x, w = np.unique(values, return_counts=True)
    y, n = x - x.mean(), len(x)
    c, cx, cxx = (np.concatenate(([0.0], np.cumsum(v))) for v in (w, w * y, w * y * y))
    cost, back = np.full((k + 1, n + 1), np.inf), np.zeros((k + 1, n + 1), int)
    cost[0, 0] = 0
    for g in range(1, k + 1):
        for j in range(g, n + 1):
            i = np.arange(g - 1, j)
            sse = cost[g - 1, i] + (cxx[j] - cxx[i]) - (cx[j] - cx[i]) ** 2 / (c[j] - c[i])
            cost[g, j], back[g, j] = sse.min(), i[sse.argmin()]
    ends, j = [], n
    for g in range(k, 0, -1):
        ends.append(float(x[j - 1]))
        j = back[g, j]
    return ends[::-1]


@pytest.mark.parametrize("block, stride, n, k", [(7, 3, 200, 5), (64, 2, 600, 3)])
def test_natural_breaks_in_blocks(spark, monkeypatch, block, stride, n, k):
    monkeypatch.setattr(breaks, "BLOCK", block)
    monkeypatch.setattr(breaks, "STRIDE", stride)
    values = np.round(np.random.default_rng(n).lognormal(3, 1.2, n), 1)
    got = natural_breaks(spark.createDataFrame([(float(v),) for v in values], "v double").repartition(3), k)
    assert got == plain_breaks(values, k)


def test_natural_breaks_of_prices(spark):
    values = np.array([float(r[0]) for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_extendedprice").collect()])
    rows = QUERIES["bins_natural_prices"](spark, SF).orderBy("class_idx").collect()
    assert [r.hi for r in rows] == plain_breaks(values, 5)


def test_blend_and_lengths(spark):
    row = spark.range(1).select(blend(F.lit("#000000"), F.lit("#ff8040"), F.lit(0.5)).alias("c"), nice_length(F.lit(1000.0)).alias("a"), nice_length(F.lit(90.0)).alias("b")).first()
    assert row.c in ("#804020", "#7f4020", "#804020") and (row.a, row.b) == (200.0, 20.0)


def test_stream_equals_table(spark, tmp_path):
    path = f"{SF}/events.parquet"
    events = spark.read.parquet(path)
    (tmp_path / "in").mkdir()
    events.write.mode("overwrite").parquet(f"{tmp_path}/in")
    stream = period_sums(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"), "event_type", "ts", "value", late="3650 days")
    query = stream.writeStream.format("memory").queryName("sums").outputMode("complete").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.start, r.event_type): (round(r.total, 4), r.n_rows) for r in spark.table("sums").collect()}
    want = {(r.start, r.event_type): (round(r.total, 4), r.n_rows) for r in period_sums(events, "event_type", "ts", "value").collect()}
    assert got == want and got


def test_natural_breaks_read_the_column_once(spark, monkeypatch):
    """What follows works on the counted values; a row with its count stands for as many rows."""
    rows = spark.createDataFrame([(float(v),) for v in [1, 1, 1, 3, 8, 9, 9, 30, 31, 31]], "v double")
    told, find = [], cl.natural_breaks
    monkeypatch.setattr(cl, "natural_breaks", lambda data, k, **more: (told.append((data.count(), more)), find(data, k, **more))[1])
    assert cl.compute_bins(rows, "v", "natural-breaks", 3).edges == [1.0, 3.0, 9.0, 31.0] == [1.0, *natural_breaks(rows, 3)]
    assert told == [(6, {"times": "n"})]
