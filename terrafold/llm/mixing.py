"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANK_CLASS, discard, stage, table, with_row_id

#: Weights that the sources take in turn, in code point order, null last.
WEIGHTS = [5, 2, 1]
#: A source gives at most so many times its size, in as many passes over its documents.
MAX_REPEAT = 3
#: Rows that one window partition holds on average, about; the number of parts follows from the input, and is no less than the cores.
PART_ROWS = 20_000
#: Sources whose targets are broadcast; more are joined by a shuffle.
SOURCES_AT_HAND = 100_000


def n_words(c: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(c, F.lit("")), BLANK_CLASS + "+"), "")).cast("long")


def source_targets(sizes: DataFrame, weights: list[int] = WEIGHTS, repeat: int = MAX_REPEAT) -> DataFrame:
    """``sizes(source, source_size)``, a row for each source, to the same with ``target`` (double), null sources included.

    The total goes round by weight; what a source cannot use above ``repeat`` times its size is shared out again. Sorted by cap
    over weight, the sources that end at their cap come first, so the level of the others follows from running sums: it falls from the
    first place on where it is no higher than the ratio, so it is the largest such. The windows see a row for each source.
    """
    w = F.lit(0)
    for i, x in enumerate(weights):
        w = F.when((F.col("place") - 1) % len(weights) == i, x).otherwise(w)
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    up = Window.orderBy("ratio", "place")
    all_rows = up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.col("total") - F.col("caps_before")) / F.col("weight_left")
    return (
        sizes.withColumn("place", F.row_number().over(order)).withColumn("weight", w.cast("long")).withColumn("cap", repeat * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(all_rows))
        .withColumn("caps_before", F.sum("cap").over(up) - F.col("cap"))
        .withColumn("weight_left", F.sum("weight").over(all_rows) - F.sum("weight").over(up) + F.col("weight"))
        .withColumn("level", F.max(F.when(level <= F.col("ratio"), level)).over(all_rows))
        .select("source", "source_size", F.when(F.col("ratio") < F.col("level"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("level")).alias("target"))
    )


def running_sum(df: DataFrame, by: list[str], part: str, order: list, size: str, out: str) -> DataFrame:
    """Running sum of ``size`` within ``by``, in the order of ``part`` and then ``order``, without a key meeting in one task.

    Sums of the parts are few; within a part a plain window runs.
    """
    parts = df.groupBy(*by, part).agg(F.sum(size).alias("part_sum"))
    before = Window.partitionBy(*by).orderBy(part)
    offsets = parts.select(*[F.col(c).alias(f"o_{c}") for c in by], F.col(part).alias("o_part"), (F.sum("part_sum").over(before) - F.col("part_sum")).alias("offset"))
    same = F.col(part) == F.col("o_part")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"o_{c}"))
    inner = Window.partitionBy(*by, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("inner_sum", F.sum(size).over(inner)).join(offsets, same).withColumn(out, F.col("inner_sum") + F.col("offset")).drop("inner_sum", "offset", "o_part", *[f"o_{c}" for c in by])


def _with_key(docs: DataFrame, row_cols: list[str]) -> DataFrame:
    """Adds ``key``, by which a source is shuffled: the MD5 of the id, then a hash of the row, so that null ids and repeats of one id are
    dealt like others."""
    return docs.withColumn("key", F.struct(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("digest"), F.xxhash64(*row_cols).alias("h"), *row_cols))


def _by_source(df: DataFrame, sources: DataFrame) -> DataFrame:
    """``df`` with the columns of ``sources``, a row for each source; few of them are broadcast, more are joined by a shuffle."""
    s = sources.withColumnRenamed("source", "of_source")
    return df.join(F.broadcast(s) if s.count() <= SOURCES_AT_HAND else s, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")


def fair_mix(docs: DataFrame, row_cols: list[str], weights: list[int] = WEIGHTS, repeat: int = MAX_REPEAT) -> tuple[DataFrame, DataFrame]:
    """``docs(*row_cols, doc_id, source, size)``, read several times, to ``(sources, rows)``: ``sources(source, source_size, target, last)``,
    where ``last`` lists for each pass over the source the key of the last row that the mix takes, and the rows with their ``key``.

    Each source is shuffled by its keys. A copy's virtual finish time is the source's words up to its end, earlier passes included,
    over the target; the copies of all sources, sorted by it, are taken while their words fit the total. So a pass takes the first
    rows of a source, up to one, and whoever knows a row's key and source knows its copies. Rows are sorted in ranges of source and
    key, hot ones in several, whose number grows with the rows; sums of ranges are few. Finish times are ranges too, of which only the
    one that the total falls into is sorted.
    """
    spark = docs.sparkSession
    rows = stage(_with_key(docs, row_cols), "mix-rows")
    n_parts = max(spark.sparkContext.defaultParallelism, rows.count() // PART_ROWS)
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stage(source_targets(sizes, weights, repeat), "mix-targets")
    budget = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0).cast("long")).alias("b")).first().b
    # Written, since ranges come from a sample: whoever reads the parts twice must see them alike.
    parted = stage(rows.repartitionByRange(n_parts, F.col("source").asc_nulls_last(), "key").withColumn("part", F.spark_partition_id()), "mix-parts")
    timed = stage(_by_source(running_sum(parted, ["source"], "part", ["key"], "size", "cum"), targets).drop("part"), "mix-timed")
    finish = (F.col("pass") * F.col("source_size") + F.col("cum")) / F.col("target")
    copies = timed.withColumn("pass", F.explode(F.array(*(F.lit(i).cast("long") for i in range(repeat))))).withColumn("finish", F.when(F.col("target") > 0, finish))
    slots = copies.withColumn("slot", F.floor(F.col("finish") * n_parts * 4).cast("long"))
    by_slot = slots.groupBy("slot").agg(F.sum("size").alias("words"))
    cum = by_slot.withColumn("upto", F.sum("words").over(Window.orderBy(F.col("slot").asc_nulls_last())))
    edge = cum.where(F.col("upto") > budget).orderBy(F.col("slot").asc_nulls_last()).limit(1).select("slot", (F.col("upto") - F.col("words")).alias("used")).first()
    taken = slots.select("source", "pass", "key")
    if edge:
        order = ["finish", F.col("source").asc_nulls_last(), "key", "pass"]
        at_edge = slots.where(F.col("slot") == edge.slot).withColumn("upto", F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
        taken = slots.where(F.col("slot") < edge.slot).select("source", "pass", "key").union(at_edge.where(F.col("upto") + edge.used <= budget).select("source", "pass", "key"))
    last = taken.groupBy("source", "pass").agg(F.max("key").alias("key")).groupBy("source").agg(F.collect_list("key").alias("last"))
    known = targets.join(last.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    out = stage(known, "mix-sources")
    discard(timed, targets, parted)
    return out, rows


def _copies() -> Column:
    """How often a row is taken: in each pass whose last row comes no earlier."""
    return F.coalesce(F.size(F.filter("last", lambda k: F.col("key") <= k)), F.lit(0)).cast("long")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: list[int] = WEIGHTS, repeat: int = MAX_REPEAT) -> DataFrame:
    """One row for each input row: ``row_id, doc_id, source, size, source_size, target, copies``.

    Size counts words; a null text has none and is free to take. Rows with equal ids are told apart by ``row_id``, the row's place
    in its input split. Other columns are ignored. Empty input: no rows. Rerunning gives the same mix.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
    sources, keyed = fair_mix(rows, ["row_id"], weights, repeat)
    return _by_source(keyed, sources).withColumn("copies", _copies()).drop("key", "last")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs``, all columns, each row as often as the mix takes it; rows it leaves go. Edge cases as in `mix_sources`. ``docs`` must
    come from a scan. Texts are not shuffled: a row's copies follow from its key and source."""
    keyed, row = with_row_id(docs)
    slim = lambda *more: keyed.select(F.col(row).alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), *more)
    sources, rows = fair_mix(slim(n_words(F.col(text_col)).alias("size")), ["row_id"])
    discard(rows)
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole")
    out = _by_source(_with_key(slim(whole), ["row_id"]), sources.select("source", "last")).select("whole", _copies().alias("copies")).where("copies > 0")
    return out.select("whole", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("whole.*")


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    """Contract: doc_id, size, source_size, target, taken."""
    out = mix_sources(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS digest FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s),
w AS (SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap FROM p),
r AS (SELECT *, cap::DOUBLE / weight AS ratio FROM w),
c AS (SELECT *, sum(cap) OVER (ORDER BY ratio, place) - cap AS caps_before, sum(weight) OVER () - sum(weight) OVER (ORDER BY ratio, place) + weight AS weight_left, sum(source_size) OVER () AS total FROM r),
v AS (SELECT *, (total - caps_before)::DOUBLE / weight_left::DOUBLE AS own_level FROM c),
l AS (SELECT *, max(CASE WHEN own_level <= ratio THEN own_level END) OVER () AS level FROM v),
t AS (SELECT source, source_size, CASE WHEN ratio < level THEN cap::DOUBLE ELSE weight * level END AS target FROM l),
q AS (SELECT d.*, t.source_size, t.target, sum(size) OVER (PARTITION BY d.source ORDER BY digest, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING)::BIGINT AS cum FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT q.*, pass, CASE WHEN target > 0 THEN (pass * source_size + cum)::DOUBLE / target END AS finish FROM q, range(3) x(pass)),
m AS (SELECT *, sum(size) OVER (ORDER BY finish NULLS LAST, source NULLS LAST, digest, doc_id NULLS FIRST, size, pass ROWS UNBOUNDED PRECEDING) AS upto FROM e)
SELECT doc_id, size, source_size, target, (size * count(*) FILTER (upto <= (SELECT sum(size) FROM d)))::BIGINT AS taken
FROM m GROUP BY doc_id, size, source_size, target, digest, cum
"""
