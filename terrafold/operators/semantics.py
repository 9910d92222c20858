"""What columns mean: facts of every column in one pass, semantics by heading and values, and the denominators of rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import headings as hd
from ..staging import discard, stage
from .order_stats import commonest, ranked_values

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")
#: semantic: (default method, allowed methods)
METHODS_OF = {
    "count": ("sum", ["sum", "mean", "median", "max", "min"]),
    "money": ("sum", ["sum", "mean", "median", "max", "min"]),
    "percent": ("weighted-mean", ["weighted-mean", "mean", "median", "max", "min"]),
    "rate-per-capita": ("recompute", ["recompute", "weighted-mean", "mean", "median"]),
    "percentage-point": ("weighted-mean", ["weighted-mean", "mean", "median"]),
    "ratio": ("weighted-mean", ["weighted-mean", "mean", "median"]),
    "score": ("mean", ["mean", "median", "max", "min"]),
    "category": ("mode", ["mode", "first"]),
}
OTHER_METHODS = ("mean", ["mean", "median"])
NEVER_SUM = ["percent", "rate-per-capita", "percentage-point", "ratio", "score"]
MAPPABLE = ["count", "percent", "rate-per-capita", "percentage-point", "money", "ratio", "score", "category", "unknown"]
#: Texts of a column that are shown as examples.
EXAMPLES = 4
#: Mean relative error up to which a pair of counts is taken to make a rate.
FIT = 0.02
# What a rate's heading says of its denominator's, in order of preference.
DENOMINATOR_HINTS = {
    "bao phu": ["dan so muc tieu", "muc tieu", "dan so"],
    "duong tinh": ["xet nghiem", "so mau", "tiep can"],
    "tiem": ["dan so muc tieu", "doi tuong", "dan so"],
    "hoan thien": ["so bao cao", "so don vi"],
    "sang loc": ["dan so muc tieu", "doi tuong"],
}


def is_number(kind: str) -> bool:
    return kind in NUMERIC or kind.startswith("decimal")


def column_facts(df: DataFrame) -> DataFrame:
    """A row for each column of ``df``: ``column, is_numeric, n_rows, present, distinct_values, lo, hi, total, integer_like,
    upper_median, examples`` (the four commonest texts, ties by text) and ``position`` (from 0).

    Cells are counted by column and text before anything is gathered, so one shuffle serves all columns. The median, an observed
    value, is found by counting ranges of values and narrowing to the one that holds its rank, the examples by a bounded aggregation:
    no column's distinct values meet in one task. Columns are few; what is kept for each is on the driver.
    """
    kinds, spark = dict(df.dtypes), df.sparkSession
    cell = lambda c: F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("text"), (F.col(f"`{c}`").cast("double") if is_number(kinds[c]) else F.lit(None).cast("double")).alias("number"))
    cells = df.select(F.explode(F.array(*map(cell, df.columns))).alias("r")).select("r.*")
    counts = stage(cells.groupBy("column", "text", F.when(F.isnan("number"), None).otherwise(F.col("number")).alias("v")).agg(F.count("*").alias("n")), "cell-counts")
    v, present = F.col("v"), F.col("text").isNotNull()
    facts = stage(counts.groupBy("column").agg(
        F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(present, F.col("n"))), F.lit(0)).alias("present"), F.count("text").alias("distinct_values"), F.min("v").alias("lo"), F.max("v").alias("hi"),
        F.sum(v * F.col("n")).alias("total"), F.coalesce(F.bool_and(F.abs(v - F.rint("v")) < 1e-9), F.lit(False)).alias("integer_like"), F.sum(F.when(v.isNotNull(), F.col("n"))).alias("numbers"),
    ), "column-sums")
    # A text has one value, and but for a negative zero a value one text: what is staged serves both as it is, without a shuffle for each round.
    medians = ranked_values(counts.select("column", "v", "n"), facts.select("column", F.floor(F.col("numbers") / 2).alias("rank")))
    texts = commonest(counts.select("column", "text", "n"), EXAMPLES)
    numeric = F.array(*(F.lit(c) for c in df.columns if is_number(kinds[c]))).cast("array<string>")
    found = spark.createDataFrame([(c, k, medians.get(c), texts.get(c, [])) for k, c in enumerate(df.columns)], "column string, position int, upper_median double, examples array<string>")
    out = stage(facts.join(F.broadcast(found), "column").drop("numbers").withColumn("is_numeric", F.array_contains(numeric, F.col("column"))), "column-facts")
    discard(counts, facts)
    return out


def semantic_of(facts: DataFrame) -> Column:
    """The semantic of each row of `column_facts`: what the heading says comes before what the values look like."""
    h, number = F.col("column"), F.col("lo").isNotNull()
    within = lambda most: number & (F.greatest(F.abs("lo"), F.abs("hi")) <= most)
    named, count = hd.naming_word(h, "time"), hd.says(h, hd.COUNT_WORDS)
    period = named["least"].isNull() | (F.col("integer_like") & (F.col("lo") >= named["least"]) & (F.col("hi") <= named["most"]))
    of_text = (
        F.when(named.isNotNull(), "time").when(hd.naming_word(h, "identifier").isNotNull(), "identifier")
        .when((F.col("distinct_values") > 0) & (F.col("distinct_values") <= F.greatest(F.lit(12.0), F.col("n_rows") * 0.15)), "category").otherwise("text")
    )
    of_number = (
        F.when(hd.says(h, hd.LON_WORDS) & within(180), "coordinate").when(hd.says(h, hd.LAT_WORDS) & within(90), "coordinate")
        .when(hd.says(h, hd.POINT_WORDS), "percentage-point").when(hd.says(h, hd.RATE_WORDS) | hd.plain(h).rlike(hd.PER_PEOPLE), "rate-per-capita")
        .when(hd.says(h, hd.MONEY_WORDS) | hd.plain(h).rlike(hd.MONEY_UNIT), "money").when(hd.says(h, hd.PERCENT_WORDS) | h.contains("%"), "percent").when(hd.says(h, hd.SCORE_WORDS), "score")
        .when(~count & named.isNotNull() & period, "time").when(count | (F.col("integer_like") & (F.col("lo") >= 0)), "count").otherwise("unknown")
    )
    return F.when(F.col("is_numeric"), of_number).otherwise(of_text)


def with_semantics(facts: DataFrame) -> DataFrame:
    """`column_facts` with ``semantic, axis, unit, scale, multiplier, default_method, allowed_methods, safe_to_sum, mappable``."""
    table = lambda k, kind: F.create_map(*(x for s, m in METHODS_OF.items() for x in (F.lit(s), F.lit(m[k]) if k == 0 else F.array(*map(F.lit, m[k])))))
    out = facts.withColumn("semantic", semantic_of(facts))
    s = F.col("semantic")
    out = out.withColumns({
        "axis": F.when(s == "coordinate", F.when(hd.says(F.col("column"), hd.LON_WORDS) & (F.greatest(F.abs("lo"), F.abs("hi")) <= 180), "lon").otherwise("lat")),
        "unit": F.when(s == "money", hd.money_unit(F.col("column"))).when(s == "rate-per-capita", hd.rate_unit(F.col("column"))).when(s == "percent", "%").otherwise(""),
        "scale": F.when(s == "percent", F.when(F.col("hi") <= 1.5, "unit").otherwise("percent")),
        "default_method": F.coalesce(F.element_at(table(0, "string"), s), F.lit(OTHER_METHODS[0])),
        "allowed_methods": F.coalesce(F.element_at(table(1, "array"), s), F.array(*map(F.lit, OTHER_METHODS[1]))),
        "safe_to_sum": ~s.isin(NEVER_SUM), "mappable": s.isin(MAPPABLE),
    })
    return out.withColumn("multiplier", hd.rate_multiplier(s, F.col("unit"), F.col("scale")))


def fitted_denominators(df: DataFrame, described: DataFrame) -> DataFrame:
    """``(rate, numerator, denominator, error)``: for each rate the pair of counts that reproduces it best, row by row.

    ``described`` is `with_semantics` of ``df``; columns are few, so pairs are planned on the driver, and all of them are judged in one
    pass: a mean relative error for each, ties to the columns that come first. A pair needs half of the rate's rows, three at least, and an error up to FIT.
    """
    rows = sorted(described.select("column", "semantic", "multiplier").collect(), key=lambda r: df.columns.index(r.column))
    counts = [r.column for r in rows if r.semantic == "count"]
    rates = [(r.column, r.multiplier) for r in rows if r.semantic in ("percent", "rate-per-capita", "percentage-point", "ratio")]
    number = lambda c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double"))
    tried = []
    for rate, scale in rates:
        for bottom in counts:
            for top in counts:
                if top != bottom:
                    r, n, d = number(rate), number(top), number(bottom)
                    error = F.when((r > 0) & (d > 0), F.abs(n / d * scale - r) / r)
                    tried.append(F.struct(F.lit(len(tried)).alias("place"), F.lit(rate).alias("rate"), F.lit(top).alias("numerator"), F.lit(bottom).alias("denominator"), F.avg(error).alias("error"), F.count(error).alias("n")))
    spark = df.sparkSession
    if not tried:
        return spark.createDataFrame([], "rate string, numerator string, denominator string, error double")
    found = df.agg(F.count("*").alias("n_rows"), F.array(*tried).alias("pairs")).select("n_rows", F.explode("pairs").alias("p")).select("n_rows", "p.*")
    good = found.where((F.col("error") <= FIT) & (F.col("n") >= F.greatest(F.lit(3.0), F.col("n_rows") * 0.5)))
    return good.groupBy("rate").agg(F.min(F.struct("error", "place", "denominator", "numerator")).alias("b")).select("rate", "b.numerator", "b.denominator", "b.error")


def named_denominators(described: DataFrame) -> DataFrame:
    """``(rate, denominator, basis)`` by names alone: most words in common (``name``), of several the largest; else what the rate's name
    hints at (``hint``); else a population (``population``). Ties go to the column that comes first."""
    rates = described.where(F.col("semantic").isin("percent", "rate-per-capita", "percentage-point", "ratio")).select(F.col("column").alias("rate"))
    counts = described.where("semantic = 'count'").select(F.col("column").alias("denominator"), F.coalesce("total", "hi", "upper_median", F.lit(0.0)).alias("size"), "position")
    r, d = hd.plain(F.col("rate")), hd.plain(F.col("denominator"))
    hint, order = F.lit(None).cast("int"), 0
    for trigger, hints in DENOMINATOR_HINTS.items():
        for word in hints:
            hint, order = F.coalesce(hint, F.when(r.contains(trigger) & d.contains(word), order)), order + 1
    overlap = F.size(F.array_intersect(hd.name_tokens(F.col("rate")), hd.name_tokens(F.col("denominator"))))
    # Columns of one table on both sides: a few hundred at most.
    pairs = rates.join(counts, F.col("rate") != F.col("denominator")).select("rate", "denominator", "size", "position", overlap.alias("overlap"), hint.alias("hint"), d.contains("dan so").alias("people"))
    best = lambda cond, *keys: F.min(F.when(cond, F.struct(*keys, "position", "denominator")))["denominator"]
    found = pairs.groupBy("rate").agg(
        best(F.col("overlap") > 0, (-F.col("overlap")).alias("a"), (-F.col("size")).alias("b")).alias("by_name"), best(F.col("hint").isNotNull(), "hint").alias("by_hint"), best(F.col("people"), F.lit(0).alias("a")).alias("by_people")
    )
    basis = F.when(F.col("by_name").isNotNull(), "name").when(F.col("by_hint").isNotNull(), "hint").when(F.col("by_people").isNotNull(), "population").otherwise("none")
    return found.select("rate", F.coalesce("by_name", "by_hint", "by_people").alias("denominator"), basis.alias("basis"))


def denominators(df: DataFrame, described: DataFrame) -> DataFrame:
    """``(rate, denominator, basis)``: ``fitted`` where arithmetic proves it, else by name."""
    fit = fitted_denominators(df, described).select("rate", F.col("denominator").alias("proved"))
    out = named_denominators(described).join(fit, "rate", "left")
    return out.select("rate", F.coalesce("proved", "denominator").alias("denominator"), F.when(F.col("proved").isNotNull(), "fitted").otherwise(F.col("basis")).alias("basis"))


def resolve_method(method: str, semantic: str, has_weight: bool) -> str:
    """The method that ``auto`` stands for; a named method stays."""
    if method != "auto":
        return method
    default = METHODS_OF.get(semantic, OTHER_METHODS)[0]
    return ("weighted-mean" if has_weight else "mean") if default == "recompute" else default


# The methods in words.
METHOD_NAMES = {
    "en": {"sum": "a sum", "mean": "an unweighted mean", "median": "a median", "max": "the maximum", "min": "the minimum", "mode": "the most frequent category", "first": "the first row", "weighted-mean": "a weighted mean"},
    "vi": {"sum": "cộng tổng", "mean": "trung bình đơn giản", "median": "trung vị", "max": "lấy giá trị lớn nhất", "min": "lấy giá trị nhỏ nhất", "mode": "lấy nhóm xuất hiện nhiều nhất", "first": "lấy dòng đầu tiên", "weighted-mean": "trung bình có trọng số"},
}
WEIGHED_BY = {"en": "{} on '{}'", "vi": "{} theo '{}'"}


def describe_method(method: str, weight: str | None = None, lang: str = "en") -> str:
    """The method in words, with the column it weighs by; an unknown one as it is called."""
    name = METHOD_NAMES[lang].get(method, method)
    return WEIGHED_BY[lang].format(name, weight) if method == "weighted-mean" and weight else name
