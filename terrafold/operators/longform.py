"""Long tables: one measure, and axes that say what each row measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.periods import period_key
from ..functions.text import is_total_like, label_of, split_ratio_role
from .semantics import with_semantics

CODE = r"^[A-Z][A-Z0-9]*(_[A-Z0-9]+)+"
# Headings of measures and of indicator axes.
MEASURE_NAMES = ["value", "amount", "result", "measure", "values", "giá trị", "gia tri", "số liệu", "so lieu", "kết quả", "ket qua"]
AXIS_NAMES = ["indicator", "metric", "measure", "variable", "chỉ số", "chi so", "chỉ tiêu", "chi tieu"]
SAME_TOTAL = 0.005


def unpivoted(df: DataFrame, columns: list[str], *keep: str) -> DataFrame:
    """``(keep.., axis, value)``: the text of each column in turn; null counts as the text "None"."""
    cells = F.array(*(F.struct(F.lit(c).alias("axis"), F.coalesce(F.col(c).cast("string"), F.lit("None")).alias("value")) for c in columns))
    return df.select(*keep, F.explode(cells).alias("cell")).select(*keep, "cell.*")


def looks_long(df: DataFrame, measures: list[str], dimensions: list[str], place: str) -> DataFrame:
    """One row: one measure, two dimensions or more, three rows or more for each place."""
    fits = len(measures) == 1 and len(dimensions) >= 2
    out = df.agg(F.count("*").alias("n_rows"), F.countDistinct(place).alias("n_places"))
    return out.withColumn("is_long", F.lit(fits) & (F.col("n_places") > 0) & (F.col("n_rows") >= 3 * F.col("n_places")))


def measure_column(columns: dict[str, bool]) -> str | None:
    """Of headings (numeric or not): the one named like a measure, else the only numeric one."""
    numeric = [c for c, is_number in columns.items() if is_number]
    named = [c for c in numeric if c.strip().lower() in MEASURE_NAMES]
    return named[0] if named else numeric[0] if len(numeric) == 1 else None


def indicator_axis(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(axis, score, levels)`` of the columns that may name indicators, best first: a telling heading, values shaped like codes, 3 to
    200 levels; 4 points are needed."""
    seen = unpivoted(df, columns).distinct().groupBy("axis").agg(F.count("*").alias("levels"), F.avg(F.col("value").rlike(CODE).cast("double")).alias("codes"))
    hint = F.when(F.lower(F.trim("axis")).isin(AXIS_NAMES), 6).otherwise(0)
    score = hint + F.when(F.col("codes") >= 0.5, 4).when(F.col("codes") > 0, 2).otherwise(0) + F.when(F.col("levels").between(3, 200), 2).otherwise(0)
    return seen.select("axis", score.alias("score"), "levels").where("score >= 4")


def varying_axes(df: DataFrame, place: str, columns: list[str]) -> DataFrame:
    """``(axis, places, extra_values)``: columns with several values within a place, and how many too many in all."""
    per = unpivoted(df, columns, place).distinct().groupBy("axis", place).agg(F.count("*").alias("n")).where("n > 1")
    return per.groupBy("axis").agg(F.count("*").alias("places"), F.sum(F.col("n") - 1).alias("extra_values"))


def double_counting_axes(df: DataFrame, place: str, columns: list[str]) -> DataFrame:
    """Varying axes whose values hold a total beside the details it sums."""
    kinds = unpivoted(df, columns).distinct().groupBy("axis").agg(F.count_if(is_total_like(F.col("value"))).alias("totals"), F.count_if(~is_total_like(F.col("value"))).alias("details"))
    return varying_axes(df, place, columns).join(kinds.where("totals > 0 and details > 0"), "axis")


def indicator_slices(df: DataFrame, indicator: str, place: str, value: str, period: str | None = None) -> DataFrame:
    """For each indicator its rows, distinct places, periods in order and raw total, which skips what is no
    number and is summed as decimals, so that the order of rows changes nothing."""
    aggs = [F.count("*").alias("n_rows"), F.countDistinct(place).alias("places"), F.round(F.try_sum(F.col(value).cast("string").try_cast("decimal(38,10)")), 1).cast("double").alias("raw_total")]
    if period:
        order = F.collect_set(F.col(period).cast("string"))
        keyed = F.array_sort(F.transform(order, period_key))
        aggs.append(F.transform(keyed, lambda k: k["text"]).alias("periods"))
    return df.groupBy(label_of(F.col(indicator)).alias("indicator")).agg(*aggs).where("indicator <> ''")


def pin_options(df: DataFrame, axis: str, place: str, value: str) -> DataFrame:
    """For each value of an axis its rows, places, total and if it reads like a total."""
    out = df.groupBy(label_of(F.col(axis)).alias("option")).agg(F.count("*").alias("n_rows"), F.countDistinct(place).alias("places"), F.coalesce(F.sum(F.col(value).try_cast("double")), F.lit(0.0)).alias("total"))
    return out.withColumn("is_total", is_total_like(F.col("option")))


def recommend_pin(options: DataFrame) -> DataFrame:
    """One row: the option with the most places, then a total, then the largest sum, then the first by name."""
    best = F.min_by(F.struct("option", "places", "total", "is_total"), F.struct((-F.col("places")).alias("a"), (~F.col("is_total")).alias("b"), (-F.col("total")).alias("c"), "option"))
    return options.agg(best.alias("b")).select("b.*")


def duplicated_totals(options: DataFrame) -> DataFrame:
    """``(option, total, head)``: options, by falling total, grouped while they stay within half a percent of the group's first; groups of
    several. The options of one axis are few: the fold runs over one sorted array of them."""
    ordered = F.reverse(F.array_sort(F.collect_list(F.struct("total", "option"))))
    start = F.struct(F.lit(None).cast("double").alias("head"), F.array().cast("array<struct<option:string,total:double,head:double>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        head = F.when(F.abs(a["head"] - x["total"]) <= SAME_TOTAL * F.abs(a["head"]), a["head"]).otherwise(x["total"])
        return F.struct(head.alias("head"), F.concat(a["out"], F.array(F.struct(x["option"].alias("option"), x["total"].alias("total"), head.alias("head")))).alias("out"))

    folded = options.where("total is not null").agg(F.aggregate(ordered, start, step)["out"].alias("out"))
    flat = folded.select(F.explode("out").alias("o")).select("o.*")
    return flat.withColumn("n", F.count("*").over(Window.partitionBy("head"))).where("n > 1").drop("n")


def ratio_pairs(names: DataFrame, column: str) -> DataFrame:
    """``(stem, numerator, denominator)`` of names that end in a word for either role over one stem."""
    stem, role = split_ratio_role(F.col(column))
    split = names.select(F.col(column).alias("name"), stem.alias("stem"), role.alias("role")).where("role is not null")
    out = split.groupBy("stem").agg(F.min(F.when(F.col("role") == "num", F.col("name"))).alias("numerator"), F.min(F.when(F.col("role") == "den", F.col("name"))).alias("denominator"))
    return out.where("numerator is not null and denominator is not null")


def channels(df: DataFrame, keys: list[str], indicator: str, value: str, requests: dict[str, tuple[str, dict[str, str]]]) -> DataFrame:
    """One column for each channel, ``name: (indicator, {column: pinned value})``: conditional sums in one pass and one shuffle."""
    cols = []
    for name, (what, pins) in requests.items():
        cond = F.trim(F.col(indicator)) == what
        for c, v in pins.items():
            cond = cond & (F.trim(F.col(c).cast("string")) == v)
        cols.append(F.sum(F.when(cond, F.col(value).try_cast("double"))).alias(name))
    return df.groupBy(*keys).agg(*cols)


def where_chain(df: DataFrame, expressions: list[str]) -> DataFrame:
    """Rows that meet every ``COLUMN=VALUE``, compared as trimmed text; the first = splits. Raises ValueError on an expression without
    a column or on a column that isn't there. With `checked_where` also where nothing is left."""
    for e in expressions:
        column, sign, wanted = (x.strip() for x in e.partition("="))
        if not sign or not column:
            raise ValueError(f"not COLUMN=VALUE: {e!r}")
        if column not in df.columns:
            raise ValueError(f"no column {column!r}; there are {', '.join(df.columns)}")
        df = df.where(F.trim(F.col(column).cast("string")) == wanted)
    return df


def checked_where(df: DataFrame, expressions: list[str]) -> DataFrame:
    """`where_chain`, which must leave rows: ValueError with the nearest values of the first expression that leaves none."""
    kept = df
    for e in expressions:
        nxt = where_chain(kept, [e])
        if nxt.isEmpty():
            column, _, wanted = (x.strip() for x in e.partition("="))
            near = [str(r.value) for r in nearest_values(kept, column, wanted).collect()]
            raise ValueError(f"no row has {column} = {wanted!r}; nearest: {', '.join(near)}")
        kept = nxt
    return kept


def nearest_values(df: DataFrame, column: str, wanted: str, most: int = 8) -> DataFrame:
    """``(value, n_rows)`` to suggest: the values that contain the wanted text, else the commonest."""
    counts = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n_rows")).where("value is not null")
    like = F.lower("value").contains(wanted.strip().lower())
    ranked = counts.withColumn("like", like).withColumn("any", F.max("like").over(Window.partitionBy(F.lit(1)))).where(F.col("like") | ~F.col("any"))
    return ranked.orderBy(F.desc("n_rows"), "value").limit(most).select("value", "n_rows")


def pin_warning(axes: DataFrame, most: int = 4) -> DataFrame:
    """One row ``(n_axes, columns, places)`` if axes double-count: which columns to pin first, and how many places it concerns."""
    first = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("places")).alias("k"), "axis"))), 1, most)
    out = axes.agg(F.count("*").alias("n_axes"), F.array_join(F.transform(first, lambda x: x["axis"]), ", ").alias("columns"), F.max("places").alias("places"))
    return out.where("n_axes > 0")


def recommend_slice(df: DataFrame, axis: str, indicator: str, place: str, value: str, pins: list[str], times: list[str] = ()) -> tuple[list[dict], list[str]]:
    """For one indicator the value to pin on each column, and the axes that still split a place afterwards.

    Time columns take their latest period, others what `recommend_pin` says, each on the rows that the pins before it left: one job
    for each of these few columns. Columns without a value stay unpinned.
    """
    kept, chosen = df.where(F.trim(F.col(axis).cast("string")) == indicator), []
    for column in [*(c for c in pins if c in times), *(c for c in pins if c not in times)]:
        options = pin_options(kept, column, place, value).where("option <> ''")
        if column in times:
            key = period_key(F.col("option"))
            pick = options.agg(F.max_by(F.struct("option", "places", "total", "is_total"), key).alias("b")).select("b.*").first()
        else:
            pick = recommend_pin(options).first()
        if pick is None or pick.option is None:
            continue
        chosen.append({"column": column, "pinned": pick.option, "places": pick.places, "total": pick.total})
        kept = kept.where(F.trim(F.col(column).cast("string")) == pick.option)
    left = [c for c in df.columns if c not in (place, value, axis, *(p["column"] for p in chosen))]
    return chosen, sorted(r.axis for r in varying_axes(kept, place, left).collect()) if left else []


def long_report(df: DataFrame, place: str, value: str, dimensions: list[str]) -> dict[str, DataFrame]:
    """What is known of a long table: if it is one, its indicator axis, what varies, what double-counts, with the warning."""
    risky = double_counting_axes(df, place, dimensions)
    return {"long": looks_long(df, [value], dimensions, place), "axis": indicator_axis(df, dimensions), "varying": varying_axes(df, place, dimensions), "double_counting": risky, "warning": pin_warning(risky)}


def parse_layer(request: str) -> dict:
    """``IND``, ``IND|COL=VAL|..`` or ``NUM / DEN`` to a name, numerator and denominator or indicator, and pins. Pins are cut off first:
    a column's name may hold a slash."""
    head, *pins = (part.strip() for part in request.split("|"))
    told = {}
    for pin in pins:
        column, sign, wanted = (x.strip() for x in pin.partition("="))
        if not sign or not column:
            raise ValueError(f"not COLUMN=VALUE: {pin!r}")
        told[column] = wanted
    if " / " in head:
        top, bottom = (x.strip() for x in head.split(" / ", 1))
        return {"name": f"{top} ÷ {bottom} (%)", "numerator": top, "denominator": bottom, "pins": told}
    return {"name": head, "indicator": head, "pins": told}


def layers(df: DataFrame, keys: list[str], indicator: str, value: str, requests: list[str]) -> DataFrame:
    """One column for each request of `parse_layer`, for each key, in one pass; a quotient is sums, then the division, in percent.

    Raises ValueError, with the nearest values, for an indicator or column that isn't there."""
    asked = [parse_layer(r) for r in requests]
    wanted = {x for a in asked for x in (a.get("indicator"), a.get("numerator"), a.get("denominator")) if x}
    there = {r.v for r in df.select(F.trim(F.col(indicator).cast("string")).alias("v")).where(F.col("v").isin(list(wanted))).distinct().collect()}
    for missing in sorted(wanted - there):
        near = [r.value for r in nearest_values(df, indicator, missing).collect()]
        raise ValueError(f"no {missing!r} in {indicator!r}; nearest: {', '.join(map(str, near))}")
    for a in asked:
        for c in a["pins"]:
            if c not in df.columns:
                raise ValueError(f"no column {c!r} for {a['name']!r}")
    parts = {}
    for k, a in enumerate(asked):
        for role in ("indicator", "numerator", "denominator"):
            if role in a:
                parts[f"c{k}_{role}"] = (a[role], a["pins"])
    out = channels(df, keys, indicator, value, parts)
    cols = [F.col(f"c{k}_indicator").alias(a["name"]) if "indicator" in a else (F.try_divide(f"c{k}_numerator", f"c{k}_denominator") * 100).alias(a["name"]) for k, a in enumerate(asked)]
    return out.select(*keys, *cols)


#: Values of an indicator that its semantic is read off, and sorts that share a large one.
SEMANTIC_SAMPLE, SEMANTIC_SHARES = 500, 64


def indicator_semantics(df: DataFrame, indicator: str, value: str, order: list[str]) -> DataFrame:
    """A row for each indicator of a long table, named ``column``, with the facts and semantics that `with_semantics` gives a column: read off
    its first SEMANTIC_SAMPLE values by ``order``, which should tell rows apart, since all share one value column.

    Rows are cut to the first ones of each task, then of each of SEMANTIC_SHARES shares of an indicator, then of the indicator, so no task
    gets more than that many samples of it. Nulls and NaN don't count; an indicator without a number has no row, nor has a null one.
    """
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v) & F.col(indicator).isNotNull()).select(F.col(indicator).cast("string").alias("column"), v.alias("v"), F.struct(*order).alias("at"))
    dealt = rows.withColumn("share", F.pmod(F.xxhash64("at"), F.lit(SEMANTIC_SHARES)))
    first = lambda df, *keys: df.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("at"))).where(F.col("k") <= SEMANTIC_SAMPLE).drop("k")
    sample = first(first(dealt, "column", "share"), "column")
    facts = sample.groupBy("column").agg(
        F.lit(True).alias("is_numeric"), F.count("*").alias("n_rows"), F.count("*").alias("present"), F.countDistinct("v").alias("distinct_values"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("v").alias("total"),
        F.bool_and(F.abs(F.col("v") - F.rint("v")) < 1e-9).alias("integer_like"),
    )
    return with_semantics(facts)
