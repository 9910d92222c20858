"""Long tables over ``events``: place is the user, indicator the event type, measure the value."""

from pyspark.sql import functions as F

from ..operators import longform as lf
from .registry import query
from .semantics import semantic_sql

# Half of the users also have total rows beside the details.
LONG_SQL = """(SELECT user_id, event_type AS indicator, CASE WHEN event_id % 2 = 0 THEN 'Male' ELSE 'Female' END AS sex, 'p' || (event_id % 4) AS period, value FROM events
UNION ALL SELECT user_id, event_type, 'Total', 'p0', sum(value) FROM events WHERE user_id % 2 = 0 GROUP BY ALL)"""


def long_table(load):
    e = load("events")
    detail = e.select("user_id", F.col("event_type").alias("indicator"), F.when(F.col("event_id") % 2 == 0, "Male").otherwise("Female").alias("sex"), F.concat(F.lit("p"), (F.col("event_id") % 4).cast("string")).alias("period"), "value")
    totals = e.where("user_id % 2 = 0").groupBy("user_id", "event_type").agg(F.sum("value").alias("value"))
    return detail.unionByName(totals.select("user_id", F.col("event_type").alias("indicator"), F.lit("Total").alias("sex"), F.lit("p0").alias("period"), "value"))


@query("long_looks_long", f"SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_places, count(*) >= 3 * count(DISTINCT user_id) AS is_long FROM {LONG_SQL}")
def long_looks_long(load, spark):
    return lf.looks_long(long_table(load), ["value"], ["indicator", "sex", "period"], "user_id")


@query("long_indicator_axis", f"""SELECT 'indicator' AS axis, 6 + CASE WHEN count(DISTINCT indicator) BETWEEN 3 AND 200 THEN 2 ELSE 0 END AS score, count(DISTINCT indicator) AS levels FROM {LONG_SQL}""")
def long_indicator_axis(load, spark):
    return lf.indicator_axis(long_table(load), ["indicator", "sex", "period"])


@query("long_code_axis", """SELECT 'code' AS axis, 4 + CASE WHEN count(DISTINCT event_type) BETWEEN 3 AND 200 THEN 2 ELSE 0 END AS score, count(DISTINCT event_type) AS levels FROM events""")
def long_code_axis(load, spark):
    coded = load("events").select(F.concat(F.lit("TX_"), F.upper("event_type")).alias("code"), F.col("user_id").cast("string").alias("user"))
    return lf.indicator_axis(coded, ["code", "user"])


VARYING = """SELECT axis, count(*) AS places, sum(n - 1)::BIGINT AS extra_values FROM (
SELECT 'indicator' AS axis, user_id, count(DISTINCT indicator) AS n FROM {t} GROUP BY user_id UNION ALL SELECT 'sex', user_id, count(DISTINCT sex) FROM {t} GROUP BY user_id
UNION ALL SELECT 'period', user_id, count(DISTINCT period) FROM {t} GROUP BY user_id) WHERE n > 1 GROUP BY axis""".format(t=LONG_SQL)


@query("long_varying_axes", VARYING)
def long_varying_axes(load, spark):
    return lf.varying_axes(long_table(load), "user_id", ["indicator", "sex", "period"])


@query("long_double_counting", f"SELECT axis, places, extra_values, 1::BIGINT AS totals, 2::BIGINT AS details FROM ({VARYING}) WHERE axis = 'sex'")
def long_double_counting(load, spark):
    return lf.double_counting_axes(long_table(load), "user_id", ["indicator", "sex", "period"])


@query("long_slices", f"""SELECT indicator, count(*) AS n_rows, count(DISTINCT user_id) AS places, round(sum(value::VARCHAR::DECIMAL(38, 10)), 1)::DOUBLE AS raw_total, array_to_string(list_sort(list(DISTINCT period)), ',') AS periods FROM {LONG_SQL} GROUP BY indicator""")
def long_slices(load, spark):
    return lf.indicator_slices(long_table(load), "indicator", "user_id", "value", "period").withColumn("periods", F.array_join("periods", ","))


OPTIONS = f"SELECT sex AS option, count(*) AS n_rows, count(DISTINCT user_id) AS places, sum(value) AS total, sex = 'Total' AS is_total FROM {LONG_SQL} WHERE indicator = 'purchase' GROUP BY sex"


def options(load):
    return lf.pin_options(long_table(load).where("indicator = 'purchase'"), "sex", "user_id", "value")


@query("long_pin_options", f"SELECT option, n_rows, places, round(total, 4) AS total, is_total FROM ({OPTIONS})")
def long_pin_options(load, spark):
    return options(load).withColumn("total", F.round("total", 4))


@query("long_recommend_pin", f"SELECT option, places, round(total, 4) AS total, is_total FROM ({OPTIONS}) ORDER BY places DESC, is_total DESC, total DESC, option LIMIT 1")
def long_recommend_pin(load, spark):
    return lf.recommend_pin(options(load)).withColumn("total", F.round("total", 4))


TOTALS = "SELECT event_type AS option, count(*)::DOUBLE * 100 AS total FROM events GROUP BY 1 UNION ALL SELECT event_type || ' copy', count(*)::DOUBLE * 100.3 FROM events GROUP BY 1"


@query("long_duplicated_totals", f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (ORDER BY total DESC, option DESC) AS k FROM ({TOTALS})),
f AS (SELECT k, option, total, total AS head FROM o WHERE k = 1 UNION ALL SELECT o.k, o.option, o.total, CASE WHEN abs(f.head - o.total) <= 0.005 * abs(f.head) THEN f.head ELSE o.total END FROM f JOIN o ON o.k = f.k + 1)
SELECT option, round(total, 4) AS total, round(head, 4) AS head FROM f QUALIFY count(*) OVER (PARTITION BY head) > 1""")  # fmt: skip
def long_duplicated_totals(load, spark):
    n = load("events").groupBy("event_type").agg(F.count("*").cast("double").alias("n"))
    rows = n.select(F.col("event_type").alias("option"), (F.col("n") * 100).alias("total")).union(n.select(F.concat("event_type", F.lit(" copy")), F.col("n") * 100.3))
    return lf.duplicated_totals(rows).select("option", F.round("total", 4).alias("total"), F.round("head", 4).alias("head"))


@query("long_ratio_pairs", "SELECT DISTINCT lower(event_type) AS stem, event_type || ' Num' AS numerator, event_type || '_Den' AS denominator FROM events WHERE event_type <> 'error'")
def long_ratio_pairs(load, spark):
    kinds = load("events").select("event_type").distinct()
    names = kinds.select(F.concat("event_type", F.lit(" Num")).alias("name")).union(kinds.where("event_type <> 'error'").select(F.concat("event_type", F.lit("_Den"))))
    return lf.ratio_pairs(names, "name")


@query("long_channels", f"""SELECT user_id, round(sum(value) FILTER (indicator = 'purchase' AND sex = 'Male'), 4) AS fill, round(sum(value) FILTER (indicator = 'view' AND sex = 'Female' AND period = 'p1'), 4) AS symbol FROM {LONG_SQL} GROUP BY user_id""")
def long_channels(load, spark):
    out = lf.channels(long_table(load), ["user_id"], "indicator", "value", {"fill": ("purchase", {"sex": "Male"}), "symbol": ("view", {"sex": "Female", "period": "p1"})})
    return out.select("user_id", F.round("fill", 4).alias("fill"), F.round("symbol", 4).alias("symbol"))


NAMED = "CASE event_type WHEN 'view' THEN 'Tỷ lệ xem (%)' WHEN 'click' THEN 'Số lượt click' WHEN 'signup' THEN 'Chênh lệch (điểm %)' ELSE event_type END"
FIRST_FACTS = f"(SELECT column_name, true AS is_numeric, count(*) AS n_rows, count(DISTINCT v) AS distinct_values, min(v) AS lo, max(v) AS hi, bool_and(abs(v - round(v)) < 1e-9) AS integer_like FROM (SELECT {NAMED} AS column_name, value AS v FROM events WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= 500) GROUP BY 1)"


@query("long_indicator_semantics", f"""SELECT column_name AS "column", n_rows, distinct_values, round(lo, 4) AS lo, round(hi, 4) AS hi, semantic FROM ({semantic_sql(FIRST_FACTS)})""")
def long_indicator_semantics(load, spark):
    """What each indicator of one value column holds, off its first 500 values."""
    out = lf.indicator_semantics(load("events").withColumn("indicator", F.expr(NAMED)), "indicator", "value", ["event_id"])
    return out.select("column", "n_rows", "distinct_values", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"), "semantic")
