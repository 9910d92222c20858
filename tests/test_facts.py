"""Facts of columns: ranks and commonest values against plain counting; ties go to the first column."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from terrafold.operators import order_stats
from terrafold.operators import semantics as sem
from terrafold.operators.order_stats import commonest, ranked_values


@pytest.mark.parametrize("few", [4, 512])
def test_ranks(spark, monkeypatch, few):
    monkeypatch.setattr(order_stats, "FEW", few)
    monkeypatch.setattr(order_stats, "PIVOTS", 5)
    rnd = random.Random(3)
    data = {"a": [rnd.randint(0, 9) for _ in range(400)], "b": [rnd.gauss(0, 1e6) for _ in range(300)], "c": [7.0], "d": [10.0**k for k in range(-150, 150)], "e": [1e300, -1e300] * 9}
    counts = spark.createDataFrame([(c, float(v), n) for c, vs in data.items() for v, n in Counter(vs).items()], "column string, v double, n long").repartition(3)
    for share in (0.0, 0.5, 0.99):
        ranks = {c: int(len(vs) * share) for c, vs in data.items()}
        got = ranked_values(counts, spark.createDataFrame([*ranks.items(), ("f", None)], "column string, rank long"))
        assert got == {c: sorted(vs)[ranks[c]] for c, vs in data.items()}


def test_commonest(spark):
    rows = [("a", t, n) for t, n in (("x", 5), ("y", 5), ("z", 9), ("w", 1), ("v", 1), ("u", 1))] + [("b", None, 4), ("b", "q", 1)]
    assert commonest(spark.createDataFrame(rows, "column string, text string, n long"), 4) == {"a": ["z", "x", "y", "u"], "b": ["q"]}


def test_facts_of_odd_columns(spark):
    rows = [(k % 3 + 0.5 if k % 4 else None, float("nan") if k % 2 else 2.0, None, "t" if k < 5 else None) for k in range(20)]
    facts = {r.column: r for r in sem.column_facts(spark.createDataFrame(rows, "x double, y double, z int, t string")).collect()}
    assert (facts["x"].present, facts["x"].upper_median, facts["x"].lo, facts["x"].hi, facts["x"].position) == (15, 1.5, 0.5, 2.5, 0)
    assert (facts["y"].upper_median, facts["y"].integer_like) == (2.0, True)
    assert (facts["z"].present, facts["z"].upper_median, facts["z"].examples) == (0, None, []) and facts["t"].examples == ["t"]
    assert sem.column_facts(spark.createDataFrame([], "x double")).count() == 0


def test_ties_go_to_the_first_column(spark):
    """Two equal denominators: the one that comes first, not first by name."""
    rows = [(10 + k, 100 + 3 * k, 100 + 3 * k, (10 + k) / (100 + 3 * k) * 100) for k in range(8)]
    df = spark.createDataFrame(rows, "`Số ca` int, `Số z` int, `Số b` int, `Tỷ lệ (%)` double")
    described = sem.with_semantics(sem.column_facts(df))
    fit = sem.fitted_denominators(df, described).first()
    assert (fit.numerator, fit.denominator) == ("Số ca", "Số z")
    named = df.select("Số ca", F.col("Số z").alias("Tổng b khám"), F.col("Số b").alias("Tổng a khám"), F.col("Tỷ lệ (%)").alias("Tỷ lệ khám (%)"))
    assert sem.named_denominators(sem.with_semantics(sem.column_facts(named))).first().denominator == "Tổng b khám"


def test_ranks_read_what_is_staged_without_a_shuffle(spark, monkeypatch):
    """Each round shuffled all distinct cells again; a negative zero is a second text of one value."""
    plans, find = [], sem.ranked_values
    monkeypatch.setattr(sem, "ranked_values", lambda counts, ranks: (plans.append(counts._jdf.queryExecution().executedPlan().toString()), find(counts, ranks))[1])
    df = spark.createDataFrame([(v,) for v in (-0.0, 0.0, 0.0, -1.0, 2.0, 3.0, None)], "v double")
    row = sem.column_facts(df).first()
    assert (row.upper_median, row.distinct_values, row.examples) == (0.0, 5, ["0.0", "-0.0", "-1.0", "2.0"])
    assert "Exchange" not in plans[0]
