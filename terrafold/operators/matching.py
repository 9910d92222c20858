"""Resolving place names against boundary units, with a reviewable table of how each was matched."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import deaccent, normalize

FUZZY_FLOOR, SURE, SECONDARY = 82.0, 93.0, 90.0


def name_index(units: DataFrame, affixes: str, parent: str | None = None) -> DataFrame:
    """``units(shape_id, name[, aliases, merged_from, canonical])`` to ``(key, shape_id, name, pos, merged_from, canonical[, parent])``.

    Aliases are indexed beside the name; spellings of one unit under one key collapse. ``pos`` keeps the units' order for ties.
    """
    spelled = F.array("name")
    if "aliases" in units.columns:
        spelled = F.concat(spelled, F.coalesce("aliases", F.array().cast("array<string>")))
    keep = [c if c in units.columns else F.lit(None).cast("string").alias(c) for c in ("merged_from", "canonical")]
    cols = [F.explode(spelled).alias("spelling"), "shape_id", "name", *keep, *([F.col(parent).alias("parent")] if parent else [])]
    out = units.select(*cols).withColumn("key", normalize(F.col("spelling"), affixes)).where("key <> ''")
    return out.drop("spelling").distinct().withColumn("pos", F.col("shape_id"))


def status_for(method: Column, score: Column, secondary: Column | None = None) -> Column:
    """How far a match can be trusted, given that of the coarser unit."""
    weak = (secondary < SECONDARY) if secondary is not None else F.lit(False)
    return (
        F.when(method == "unmatched", "unmatched").when(method == "ambiguous", "needs-review")
        .when(method == "fuzzy", F.when((score < SURE) | weak, "needs-review").otherwise("high-confidence"))
        .otherwise(F.when(weak, "needs-review").otherwise("high-confidence"))
    )


def match_names(names: DataFrame, index: DataFrame, affixes: str, by: list[str] | None = None) -> DataFrame:
    """Distinct ``names(raw[, by..])`` to ``(raw, [by..], method, score, shape_id, matched, candidates)`` by equal keys.

    A key hit is a merged unit, the literal name (exact), one name spelled otherwise (normalised) or one of several (ambiguous,
    the first carried along). Names without a hit come out unmatched; `fuzzy_names` can try those. One equi-join on the key; the
    index is small against the rows, which are deduplicated before.
    """
    by = by or []
    asked = names.withColumn("key", normalize(F.col("raw"), affixes))
    hit = asked.join(index.withColumnRenamed("parent", by[0]) if by else index, ["key", *by], "left")
    literal = F.trim("name") == F.trim("raw")
    first = F.struct(F.coalesce(~literal, F.lit(True)).alias("o"), "pos", "shape_id", "name", "merged_from", "canonical")
    grouped = hit.groupBy("raw", *by).agg(
        F.min(F.when(F.col("shape_id").isNotNull(), first)).alias("c"), F.countDistinct("name").alias("n_names"), F.max(F.coalesce(literal, F.lit(False))).alias("literal"),
        F.array_join(F.array_sort(F.collect_set("name")), "; ").alias("all_names"),
    )
    method = (
        F.when(F.col("c").isNull(), "unmatched").when(F.coalesce(F.col("c.merged_from"), F.lit("")) != "", "merged").when(F.col("literal"), "exact")
        .when(F.col("n_names") > 1, "ambiguous").otherwise("normalised")
    )
    return grouped.select(
        "raw", *by, method.alias("method"), F.when(F.col("c").isNull(), 0.0).otherwise(100.0).alias("score"), F.col("c.shape_id").alias("shape_id"),
        F.coalesce("c.canonical", "c.name", F.lit("")).alias("matched"), F.when(method == "ambiguous", F.col("all_names")).otherwise("").alias("candidates"),
    )


def indel_ratio(a: str, b: str) -> float:
    """200 times the longest common subsequence over both lengths, by bits."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    row = (1 << len(a)) - 1
    for ch in b:
        up = row & where.get(ch, 0)
        row = (row + up) | (row - up)
    common = len(a) - (row & ((1 << len(a)) - 1)).bit_count()
    return 200.0 * common / (len(a) + len(b))


def _similar(a: pd.Series, b: pd.Series) -> pd.Series:
    def words(x: str) -> str:
        return " ".join(sorted(x.split()))

    return pd.Series(np.array([max(indel_ratio(x, y), indel_ratio(words(x), words(y))) for x, y in zip(a, b)], float))


def similarity(a: str, b: str) -> Column:
    """The better of the plain ratio of two columns and that of their words in order."""
    return F.pandas_udf(_similar, T.DoubleType())(a, b)


#: Letter pairs whose frequency decides their place among a key's pairs; rarer ones come first, whatever they are.
KNOWN_PAIRS = 4096


def _pairs(c: Column) -> Column:
    """array<string>: pairs of neighbouring characters of a key, blanks and both ends included, each with how often it came before."""
    framed = F.concat(F.lit("\x02"), c, F.lit("\x03"))
    plain = F.transform(F.sequence(F.lit(1), F.length(framed) - 1), lambda i: F.substring(framed, i, F.lit(2)))
    return F.transform(plain, lambda p, i: F.concat(p, F.size(F.filter(F.slice(plain, F.lit(1), i + 1), lambda q: q == p)).cast("string")))


def _least_shared(c: Column, floor: float) -> Column:
    """How many of its pairs a key shares with any that is similar by ``floor``. Of a key of m characters a deletion takes two pairs, an
    insertion one; with f the floor as a share, d deletions and e insertions have (2 - f) d + f e <= 2 (1 - f) m."""
    f = floor / 100
    lost = max(4 * (1 - f) / (2 - f), 2 * (1 - f) / f)
    if lost >= 1:
        raise ValueError(f"keys as unlike as {floor} may share no letter pair")
    return F.ceil(F.length(c) * (1 - lost) + 1 - 1e-9).cast("int")


def _candidates(asked: DataFrame, known: DataFrame, floor: float, by: list[str]) -> DataFrame:
    """``asked(key, a, by..)`` and ``known(known, b, by..)`` to all ``(key, known, by..)`` whose texts ``a`` and ``b`` may be similar by ``floor``.

    Similar keys share so many pairs that, with all pairs in one order, the first of either key (as many as it can lose, and one) share
    one: an equi-join on those, rarest first, finds every pair. Lengths and the number of shared pairs then decide what is compared.
    """
    bags = [df.withColumn("bag", _pairs(F.col(c))).withColumn("least", _least_shared(F.col(c), floor)) for df, c in ((asked, "a"), (known, "b"))]
    often = bags[1].select(F.explode("bag").alias("p")).groupBy("p").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p").limit(KNOWN_PAIRS).collect()
    place = F.create_map(*(x for r in often for x in (F.lit(r.p), F.lit(r.n)))) if often else F.create_map().cast("map<string,int>")
    first = lambda bag, least: F.transform(F.slice(F.array_sort(F.transform(bag, lambda p: F.struct(F.coalesce(F.element_at(place, p).cast("long"), F.lit(0)).alias("n"), p.alias("p")))), F.lit(1), F.size(bag) - least + 1), lambda x: x["p"])
    left, right = (bag.withColumn("pair", F.explode(first(F.col("bag"), F.col("least")))).withColumnRenamed("bag", f"bag_{k}").withColumnRenamed("least", f"least_{k}") for k, bag in enumerate(bags))
    near = 2 * F.least(F.length("a"), F.length("b")) >= floor / 100 * (F.length("a") + F.length("b")) - 1e-9
    enough = F.size(F.array_intersect("bag_0", "bag_1")) >= F.greatest("least_0", "least_1")
    return left.join(right, ["pair", *by]).where(near & enough).select("key", "known", *by).distinct()


def fuzzy_names(missed: DataFrame, index: DataFrame, affixes: str, by: list[str] | None = None, floor: float = FUZZY_FLOOR) -> DataFrame:
    """Names that no key hit, to ``(raw, [by..], score, shape_id, name)``: the best similarity at or over the floor, the first unit on ties.

    All similar keys are found, by the keys as they are and by their words in order: see `_candidates`. Only those are compared.
    """
    by = by or []
    in_order = lambda c: F.array_join(F.array_sort(F.filter(F.split(c, " "), lambda w: w != "")), " ")
    asked = missed.select("raw", *by).distinct().withColumn("key", normalize(F.col("raw"), affixes)).where("key <> ''")
    known = (index.withColumnRenamed("parent", by[0]) if by else index).select(F.col("key").alias("known"), "shape_id", "name", "pos", *by)
    keys, units = asked.select("key", *by).distinct(), known.select("known", *by).distinct()
    plain = _candidates(keys.withColumn("a", F.col("key")), units.withColumn("b", F.col("known")), floor, by)
    words = _candidates(keys.withColumn("a", in_order("key")), units.withColumn("b", in_order("known")), floor, by)
    scored = plain.union(words).distinct().withColumn("score", similarity("key", "known")).where(F.col("score") >= floor)
    found = asked.join(scored, ["key", *by]).join(known, ["known", *by])
    best = F.max_by(F.struct("score", "shape_id", "name"), F.struct("score", (-F.col("pos")).alias("first")))
    return found.groupBy("raw", *by).agg(best.alias("b")).select("raw", *by, "b.*")


def review(rows: DataFrame, name: str, index: DataFrame, affixes: str, fuzzy: bool = True) -> DataFrame:
    """The match table of a one-level dataset: a record for each distinct name with its rows counted before any join."""
    names = rows.select(F.trim(F.coalesce(F.col(name), F.lit(""))).alias("raw")).groupBy("raw").agg(F.count("*").alias("row_count"))
    found = match_names(names.select("raw"), index, affixes)
    if fuzzy:
        guess = fuzzy_names(found.where("method = 'unmatched'"), index, affixes).select("raw", F.col("score").alias("g_score"), F.col("shape_id").alias("g_shape"), F.col("name").alias("g_name"))
        got = F.col("g_shape").isNotNull()
        found = found.join(guess, "raw", "left").select(
            "raw", F.when(got, "fuzzy").otherwise(F.col("method")).alias("method"), F.when(got, F.col("g_score")).otherwise(F.col("score")).alias("score"),
            F.coalesce("shape_id", "g_shape").alias("shape_id"), F.when(got, F.col("g_name")).otherwise(F.col("matched")).alias("matched"), "candidates",
        )
    out = found.join(names, "raw")
    return out.select(
        F.col("raw").alias("dataset_province"), F.col("matched").alias("matched_province"), F.round("score", 1).alias("province_score"), F.col("method").alias("match_method"),
        status_for(F.col("method"), F.col("score")).alias("status"), "shape_id", "candidates", "row_count",
    )


def review_nested(rows: DataFrame, coarse: str, fine: str, coarse_index: DataFrame, fine_index: DataFrame, affixes: str, overrides: DataFrame | None = None) -> DataFrame:
    """The match table of two levels: the coarse name first, then the fine one among that unit's own.

    ``overrides(coarse, fine, shape_id, matched)``, lower-cased names, beats matching.
    """
    pairs = rows.select(F.trim(F.coalesce(F.col(coarse), F.lit(""))).alias("p"), F.trim(F.coalesce(F.col(fine), F.lit(""))).alias("raw")).groupBy("p", "raw").agg(F.count("*").alias("row_count"))
    up = match_names(pairs.select(F.col("p").alias("raw")).distinct(), coarse_index, affixes).select(F.col("raw").alias("p"), F.col("matched").alias("matched_province"), F.col("score").alias("province_score"), F.col("method").alias("p_method"))
    both = pairs.join(up, "p")
    inner = match_names(both.where("matched_province <> ''").select("raw", F.col("matched_province").alias("unit")).distinct(), fine_index, affixes, by=["unit"])
    out = both.join(inner.withColumnRenamed("unit", "matched_province"), ["matched_province", "raw"], "left")
    if overrides is not None:
        manual = overrides.select(F.lower("coarse").alias("o_p"), F.lower("fine").alias("o_c"), F.col("shape_id").alias("o_shape"), F.col("matched").alias("o_name"))
        where = (F.lower(F.when(F.col("matched_province") != "", F.col("matched_province")).otherwise(F.col("p"))) == F.col("o_p")) & (F.lower("raw") == F.col("o_c"))
        hand = F.col("o_shape").isNotNull()
        out = out.join(manual, where, "left").select(
            "p", "raw", "row_count", "matched_province", "province_score", "candidates", F.when(hand, "override").otherwise(F.col("method")).alias("method"),
            F.when(hand, 100.0).otherwise(F.col("score")).alias("score"), F.when(hand, F.col("o_shape")).otherwise(F.col("shape_id")).alias("shape_id"),
            F.when(hand, F.col("o_name")).otherwise(F.col("matched")).alias("matched"),
        )
    method, score = F.coalesce("method", F.lit("unmatched")), F.coalesce("score", F.lit(0.0))
    return out.select(
        F.col("p").alias("dataset_province"), F.col("raw").alias("dataset_commune"), "matched_province", F.coalesce("matched", F.lit("")).alias("matched_commune"), "province_score",
        score.alias("commune_score"), F.round((F.col("province_score") + score) / 2, 1).alias("match_score"), method.alias("match_method"),
        status_for(method, score, F.col("province_score")).alias("status"), "shape_id", F.coalesce("candidates", F.lit("")).alias("candidates"), "row_count",
    )


def summarize(reviewed: DataFrame) -> DataFrame:
    """One row of counts by status and method."""
    return reviewed.agg(
        F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(s.replace("-", "_")) for s in ("high-confidence", "needs-review", "unmatched")),
        *(F.count_if(F.col("match_method") == m).alias(f"by_{m}") for m in ("exact", "normalised", "ambiguous", "merged", "fuzzy", "override")),
    )


def attach_shapes(rows: DataFrame, name: str, reviewed: DataFrame, keep_ambiguous: bool = False) -> DataFrame:
    """Rows whose name was matched, with ``shape_id``: ambiguous names stay out unless asked for. The table of distinct names is the
    small side; Spark broadcasts it if its measured size allows."""
    found = reviewed.where(F.col("shape_id").isNotNull() & (F.lit(keep_ambiguous) | (F.col("match_method") != "ambiguous")))
    keyed = rows.withColumn("dataset_province", F.trim(F.coalesce(F.col(name), F.lit(""))))
    return keyed.join(found.select("dataset_province", "shape_id"), "dataset_province").drop("dataset_province")


def crosswalk(units: DataFrame, name: str, merger: str, renames: dict[str, str] | None = None) -> DataFrame:
    """``(former, current)``: the comma-separated former units of each current one; a unit without a merger maps to itself."""
    text = F.trim(F.coalesce(F.col(merger), F.lit("")))
    alone = (text == "") | (deaccent(text) == "khong sap nhap")
    parts = units.select(F.col(name).alias("current"), F.explode(F.when(alone, F.array(name)).otherwise(F.split(text, ","))).alias("f"))
    out = parts.select(F.trim("f").alias("former"), "current").where("former <> ''")
    for old, new in (renames or {}).items():
        out = out.union(out.where(F.col("current") == new).select(F.lit(old), "current").distinct())
    return out.distinct()


def crosswalk_units(units: DataFrame, name: str, merger: str, shape: str, affixes: str) -> DataFrame:
    """Units for `name_index`: the current names, then each former name that is not also current, marked as merged."""
    now = units.select(F.col(shape).alias("shape_id"), F.col(name).alias("name"), F.lit("").alias("merged_from"), F.col(name).alias("canonical"))
    former = crosswalk(units, name, merger).where("former <> current").join(now.select("shape_id", F.col("name").alias("current")), "current")
    all_units = now.withColumn("rank", F.lit(0)).unionByName(former.select("shape_id", F.col("former").alias("name"), F.col("former").alias("merged_from"), F.col("current").alias("canonical"), F.lit(1).alias("rank")))
    one = Window.partitionBy("key").orderBy("rank", "shape_id")
    return all_units.withColumn("key", normalize(F.col("name"), affixes)).withColumn("k", F.row_number().over(one)).where("k = 1").drop("k", "key", "rank")


def parent_links(coarse: DataFrame, coarse_name: str, fine: DataFrame, columns: list[str], affixes: str) -> DataFrame:
    """For each column of the fine tier, the share of its values that are names of coarse units; 0.5 links, 0.999 is sure."""
    keys = coarse.select(normalize(F.col(coarse_name), affixes).alias("key")).distinct().withColumn("known", F.lit(1))
    long = fine.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), normalize(F.col(c).cast("string"), affixes).alias("key")) for c in columns))).alias("r")).select("r.*").where("key <> ''")
    counted = long.groupBy("column", "key").agg(F.count("*").alias("n")).join(keys, "key", "left")
    out = counted.groupBy("column").agg((F.sum(F.when(F.col("known") == 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("share"))
    return out.withColumn("linked", F.col("share") >= 0.5).withColumn("sure", F.col("share") >= 0.999)


def place_columns(rows: DataFrame, columns: list[str], provinces: DataFrame, communes: DataFrame | None, affixes: str, weighted: bool = False) -> DataFrame:
    """``(column, province_share, commune_share, distinct_values)``: how many of a column's distinct values (of its rows, if weighted) are
    names of either tier (``provinces(key)``, ``communes(key)``); names of both count as provinces only."""
    known = provinces.select("key", F.lit("p").alias("tier"))
    if communes is not None:
        known = known.unionByName(communes.select("key", F.lit("c").alias("tier")).join(provinces.select("key"), "key", "left_anti"))
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), normalize(F.col(c).cast("string"), affixes).alias("key")) for c in columns))).alias("r")).select("r.*").where("key <> ''")
    counted = long.groupBy("column", "key").agg(F.count("*").alias("n")).join(known.distinct(), "key", "left")
    weight = F.col("n") if weighted else F.lit(1)
    share = lambda tier: F.sum(F.when(F.col("tier") == tier, weight).otherwise(0)) / F.sum(weight)
    return counted.groupBy("column").agg(share("p").alias("province_share"), share("c").alias("commune_share"), F.count("*").alias("distinct_values"))


def admin_level(shares: DataFrame) -> DataFrame:
    """One row: commune if any column reaches 0.85 of the fine tier, else province if one reaches 0.60 of the coarse, else unknown."""
    level = F.when(F.max("commune_share") >= 0.85, "commune").when(F.max("province_share") >= 0.60, "province").otherwise("unknown")
    return shares.agg(level.alias("admin_level"))


# What is no name but a code; lengths of names; what they weigh.
CODE_SHAPE = r"^[^\p{L}]*$|^[A-Z]{1,4}[.\-_][\p{L}\p{N}_.\-]*$"
NAME_LENGTHS, LONGEST_NAME, SPACED, USUAL, TOO_SHORT, TOO_LONG = (5, 30), 60, 0.15, 0.15, -0.45, -0.25


def name_column_scores(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, score)``: how much each column looks like names, between 0 and 1: 0 where under half the values differ or their upper
    median length is under 2 or over 60; else the share of values with letters, less codes and "NA", plus 0.15 of those with a blank,
    and by the median length 0.15 more (5 to 30), 0.45 less (shorter) or 0.25 less (longer).

    Values are counted before the window that finds the median, which then sees lengths only.
    """
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.trim(F.col(c).cast("string")).alias("v")) for c in columns))).alias("r")).select("r.*").where("v is not null")
    per = long.groupBy("column", "v").agg(F.count("*").alias("n")).withColumn("size", F.length("v"))
    sizes = per.groupBy("column", "size").agg(F.sum("n").alias("m"))
    w = Window.partitionBy("column")
    middle = sizes.withColumn("upto", F.sum("m").over(w.orderBy("size"))).withColumn("of", F.sum("m").over(w)).where(F.col("upto") > F.floor(F.col("of") / 2)).groupBy("column").agg(F.min("size").alias("median"))

    def share(cond: Column) -> Column:
        return F.sum(F.when(cond, F.col("n")).otherwise(0)) / F.sum("n")

    raw = share(F.col("v").rlike(r"\p{L}")) - share(F.col("v").rlike(CODE_SHAPE)) - share(F.col("v") == "NA") + SPACED * share(F.col("v").contains(" "))
    found = per.groupBy("column").agg(raw.alias("raw"), (F.count("*") / F.sum("n")).alias("variety")).join(middle, "column")
    low, high = NAME_LENGTHS
    by_length = F.when(F.col("median").between(low, high), USUAL).when(F.col("median") < low, TOO_SHORT).otherwise(TOO_LONG)
    score = F.least(F.greatest(F.col("raw") + by_length, F.lit(0.0)), F.lit(1.0))
    return found.select("column", F.when((F.col("variety") < 0.5) | ~F.col("median").between(2, LONGEST_NAME), 0.0).otherwise(score).alias("score"))
