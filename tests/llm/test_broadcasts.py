"""What Spark would broadcast for an estimate of its file, or of rows before an explode."""

import pytest
from pyspark.sql import functions as F

from terrafold.llm import common, simhash
from terrafold.staging import merged_joins, stage


def planned(df):
    """The joins and broadcasts of a plan before any part of it ran."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {x for x in ("BroadcastExchange", "SortMergeJoin") if x in plan}


@pytest.fixture
def staged_plans(spark, monkeypatch):
    """For each table that near copies or groups stage: what its plan holds."""
    from terrafold.operators import components

    found = []
    for module in (simhash, components):
        write = module.stage
        monkeypatch.setattr(module, "stage", lambda df, tag, write=write: (found.append((tag, planned(df))), write(df, tag))[1])
    return found


def test_index_of_prints_is_not_broadcast(spark):
    """67 rows a print: 0.5 GB of texts have 15 million, which Spark takes for 4 MB."""
    prints = stage(spark.range(200).select("id", F.xxhash64("id").alias("fp")), "prints")
    assert planned(simhash.hamming_links(prints, 4)) == {"SortMergeJoin"}


def test_groups_are_not_broadcast_for_an_estimate(spark, staged_plans):
    docs = stage(spark.createDataFrame([(k, f"one two three four five {k % 7}") for k in range(30)], "doc_id long, text string"), "texts")
    out = simhash.simhash_groups(docs)
    assert planned(out) == {"SortMergeJoin"} and out.count() == 30
    assert {"named-prints", "links"} <= {tag for tag, _ in staged_plans} and not any("BroadcastExchange" in x for _, x in staged_plans)


def test_near_copies_are_not_broadcast_for_an_estimate(spark, staged_plans):
    docs = stage(spark.createDataFrame([(k, f"one two three four five six seven {k % 7}") for k in range(30)], "doc_id long, text string"), "texts")
    assert simhash.drop_near_copies(docs).count() == 7
    assert {"star-pairs", "located-pairs", "near-copies"} <= {tag for tag, _ in staged_plans} and not any("BroadcastExchange" in x for _, x in staged_plans)


@pytest.mark.parametrize("at_hand", [1000, 0])
def test_rows_that_go_are_bits(spark, monkeypatch, at_hand):
    """Rows of several files go by their place; a row in 64 is as much to broadcast as all of them."""
    monkeypatch.setattr(common, "WORDS_AT_HAND", at_hand)
    docs = stage(spark.range(0, 1000, 1, 3).select(F.col("id").alias("row_id"), F.lit(7).alias("word"), F.lit("x").alias("a b")), "rows")
    keyed, row = common.with_row_id(docs)
    gone = stage(keyed.where("row_id % 64 = 63 or row_id % 5 = 0 or row_id > 800").select(row), "gone")
    assert gone.count() > 200
    out = common.without_rows(keyed, row, gone)
    assert out.columns == docs.columns and sorted(r.row_id for r in out.collect()) == [k for k in range(801) if k % 64 != 63 and k % 5]
    assert planned(out) == {"BroadcastExchange" if at_hand else "SortMergeJoin"}
    assert common.without_rows(keyed, row, gone.limit(0)).count() == 1000


def test_a_small_file_is_no_small_table(spark):
    """A column of one value is a small file: 2,000,000 rows of it would be broadcast. Settings come back as they were."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = [spark.conf.get(k, None) for k in keys]
    big = stage(spark.range(2_000_000).select((F.col("id") % 5).alias("k"), F.lit(1).alias("one")), "flat")
    many = big.groupBy("k").agg(F.sum("one").alias("n"))
    assert planned(many.join(big, "k")) == {"BroadcastExchange"}
    with merged_joins(spark), merged_joins(spark):
        out = many.join(big, "k")
        assert planned(out) == {"SortMergeJoin"} and out.count() == 2_000_000
        assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
        assert planned(many.join(F.broadcast(big.limit(1)), "k")) == {"BroadcastExchange"}
    assert [spark.conf.get(k, None) for k in keys] == before
