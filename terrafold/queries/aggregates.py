"""Combining, ratios, changes, filters and profiles."""

from pyspark.sql import functions as F

from ..functions.text import integer_like
from ..operators import aggregate as agg
from ..operators import longform as lf
from .registry import query

VALUE_SQL = "CASE WHEN l_quantity > 25 THEN l_extendedprice END"


def _lines(load):
    weight = F.expr("CASE WHEN l_linenumber % 3 = 0 THEN 0.0 WHEN l_suppkey % 7 = 0 THEN NULL ELSE l_quantity END")
    row = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return load("lineitem").select("*", F.expr(VALUE_SQL).alias("v"), weight.alias("w"), row.alias("row"))


def _combine(name: str, method: str, sql: str, column: str = "v", digits: int = 4):
    @query(name, f"SELECT l_suppkey, l_linenumber, {sql} AS value, count(*) AS n_rows FROM (SELECT *, {VALUE_SQL} AS v FROM lineitem) GROUP BY ALL")
    def run(load, spark):
        out = agg.combine(_lines(load), ["l_suppkey", "l_linenumber"], column, method, order="row")
        return out if method in ("mode", "max", "min") else out.withColumn("value", F.round("value", digits))


_combine("agg_sum_min_count", "sum", "round(sum(v), 2)", digits=2)
_combine("agg_mean", "mean", "round(avg(v), 4)")
_combine("agg_median", "median", "round(median(v), 4)")
_combine("agg_max", "max", "max(v)")
_combine("agg_min", "min", "min(v)")
_combine("agg_first", "first", "round(arg_min(v, (l_orderkey, l_linenumber, l_partkey, l_extendedprice)) FILTER (v IS NOT NULL), 4)")


@query("agg_mode", """SELECT l_suppkey, arg_min(l_returnflag, (-n, l_returnflag)) AS value, sum(n)::BIGINT AS n_rows
FROM (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY l_suppkey""")  # fmt: skip
def agg_mode(load, spark):
    return agg.combine(_lines(load), ["l_suppkey"], "l_returnflag", "mode")


WEIGHT_SQL = "CASE WHEN l_linenumber % 3 = 0 THEN 0.0 WHEN l_suppkey % 7 = 0 THEN NULL ELSE l_quantity END"


@query("agg_weighted_mean", f"""SELECT l_suppkey, round(coalesce(sum(v * w) FILTER (v IS NOT NULL AND w > 0) / nullif(sum(w) FILTER (v IS NOT NULL AND w > 0), 0), avg(v)), 4) AS value, count(*) AS n_rows
FROM (SELECT *, l_discount AS v, {WEIGHT_SQL} AS w FROM lineitem) GROUP BY l_suppkey""")  # fmt: skip
def agg_weighted_mean(load, spark):
    return agg.combine(_lines(load), ["l_suppkey"], "l_discount", "weighted-mean", weight="w").withColumn("value", F.round("value", 4))


@query("agg_weighted_mean_fallback", """SELECT l_suppkey, round(avg(l_discount), 4) AS value, count(*) AS n_rows FROM lineitem GROUP BY l_suppkey""")
def agg_weighted_mean_fallback(load, spark):
    return agg.combine(_lines(load).withColumn("none", F.lit(0.0)), ["l_suppkey"], "l_discount", "weighted-mean", weight="none").withColumn("value", F.round("value", 4))


@query("dup_count", "SELECT count(*) AS duplicated_keys FROM (SELECT l_orderkey, l_suppkey FROM lineitem GROUP BY ALL HAVING count(*) > 1)")
def dup_count(load, spark):
    return agg.duplicate_count(load("lineitem"), ["l_orderkey", "l_suppkey"])


@query("spread_totals", """SELECT l_orderkey, l_linenumber, round(sum(l_extendedprice) OVER (PARTITION BY l_orderkey), 2) AS order_total FROM lineitem""")
def spread_totals(load, spark):
    rows = load("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    totals = rows.groupBy("l_orderkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("order_total"))
    return agg.spread(rows, totals, ["l_orderkey"]).drop("l_extendedprice")


@query("ratio_sum_then_divide", """SELECT user_id, round(sum(value) FILTER (event_type = 'purchase'), 4) AS numerator, round(sum(value) FILTER (event_type = 'view'), 4) AS denominator,
round(CASE WHEN sum(value) FILTER (event_type = 'view') <> 0 THEN sum(value) FILTER (event_type = 'purchase') / sum(value) FILTER (event_type = 'view') * 100 END, 4) AS ratio FROM events GROUP BY user_id""")  # fmt: skip
def ratio_sum_then_divide(load, spark):
    kind = lambda k: F.when(F.col("event_type") == k, F.col("value"))
    out = agg.ratio_of_sums(load("events"), ["user_id"], kind("purchase"), kind("view"))
    return out.select("user_id", *(F.round(c, 4).alias(c) for c in ("numerator", "denominator", "ratio")))


@query("wide_ratio", """SELECT l_suppkey, round(sum(l_extendedprice * l_discount), 2) AS numerator, round(sum(l_extendedprice), 2) AS denominator, round(sum(l_extendedprice * l_discount) / sum(l_extendedprice) * 100, 6) AS ratio FROM lineitem GROUP BY l_suppkey""")
def wide_ratio(load, spark):
    rows = load("lineitem").select("l_suppkey", (F.col("l_extendedprice") * F.col("l_discount")).alias("rebate/item"), "l_extendedprice")
    out = agg.wide_ratio(rows, ["l_suppkey"], "rebate/item / l_extendedprice")
    return out.select("l_suppkey", F.round("numerator", 2).alias("numerator"), F.round("denominator", 2).alias("denominator"), F.round("ratio", 6).alias("ratio"))


@query("ratio_zero_denominator", """SELECT count(*) FILTER (d = 0 OR d IS NULL) AS no_data, count(*) FILTER (d <> 0) AS with_data
FROM (SELECT user_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS d FROM events GROUP BY user_id)""")  # fmt: skip
def ratio_zero_denominator(load, spark):
    errors = F.when(F.col("event_type") == "error", 1).otherwise(0)
    out = agg.ratio_of_sums(load("events"), ["user_id"], F.lit(1), errors)
    return out.agg(F.count_if(F.col("ratio").isNull()).alias("no_data"), F.count_if(F.col("ratio").isNotNull()).alias("with_data"))


YEARS_SQL = """SELECT c_nationkey, sum(o_totalprice) FILTER (year(o_orderdate) = 1996) AS baseline, sum(o_totalprice) FILTER (year(o_orderdate) = 1997) AS comparison
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey"""


def two_years(load):
    year = F.year("o_orderdate")
    rows = load("orders").join(load("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy("c_nationkey").agg(F.sum(F.when(year == 1996, F.col("o_totalprice"))).alias("baseline"), F.sum(F.when(year == 1997, F.col("o_totalprice"))).alias("comparison"))


@query("change_two_columns", f"SELECT c_nationkey, round(comparison - baseline, 2) AS change, round((comparison - baseline) / nullif(baseline, 0) * 100, 4) AS points FROM ({YEARS_SQL})")
def change_two_columns(load, spark):
    change = F.col("change")
    return agg.with_change(two_years(load), "baseline", "comparison").select("c_nationkey", F.round(change, 2).alias("change"), F.round(change / F.nullif("baseline", F.lit(0)) * 100, 4).alias("points"))


@query("where_chain", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def where_chain(load, spark):
    return lf.where_chain(load("orders"), ["o_orderstatus=F", "o_orderpriority = 1-URGENT"]).select("o_orderkey", "o_totalprice")


@query("where_nearest_values", "SELECT p_type AS value, count(*) AS n_rows FROM part WHERE p_type ILIKE '%a%' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def where_nearest_values(load, spark):
    return lf.nearest_values(load("part"), "p_type", "A")


@query("period_filter", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE strftime(ts, '%Y-%m') = (SELECT min(strftime(ts, '%Y-%m')) FROM events) GROUP BY event_type")
def period_filter(load, spark):
    e = load("events").withColumn("period", F.date_format("ts", "yyyy-MM"))
    first = e.agg(F.min("period").alias("period")).first().period
    return agg.period_filter(e, "period", first).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("profile_columns", """WITH u AS (
SELECT 'o_orderkey' AS c, o_orderkey::VARCHAR AS t, o_orderkey::DOUBLE AS n FROM orders UNION ALL SELECT 'o_custkey', o_custkey::VARCHAR, o_custkey::DOUBLE FROM orders
UNION ALL SELECT 'o_orderstatus', o_orderstatus, NULL FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority, NULL FROM orders)
SELECT c AS "column", count(*) AS "rows", count(*) FILTER (t IS NULL) / count(*) AS missing, count(DISTINCT t) AS distinct_values, min(n) AS min, max(n) AS max, sum(n) AS total FROM u GROUP BY c""")  # fmt: skip
def profile_columns(load, spark):
    return agg.profile_columns(load("orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])


@query("upper_median", """SELECT o_orderpriority, list_sort(list(o_totalprice))[count(*) // 2 + 1] AS upper_median FROM orders GROUP BY o_orderpriority""")
def upper_median(load, spark):
    return agg.upper_median(load("orders"), ["o_orderpriority"], "o_totalprice")


@query("integer_like", "SELECT bool_and(abs(o_totalprice - round(o_totalprice)) < 1e-9) AS price, bool_and(abs(o_custkey - round(o_custkey)) < 1e-9) AS customer FROM orders")
def integer_like_columns(load, spark):
    return load("orders").agg(integer_like(F.col("o_totalprice")).alias("price"), integer_like(F.col("o_custkey").cast("double")).alias("customer"))


@query("agg_described", f"""SELECT l_returnflag AS grp, sum(l_linenumber)::DOUBLE AS cases, round(sum(p * l_quantity) FILTER (p IS NOT NULL) / sum(l_quantity) FILTER (p IS NOT NULL), 6) AS positivity, round(sum(l_extendedprice), 2) AS budget, round(avg(l_tax * 10 + 0.5), 6) AS score, count(*) AS n_rows
FROM (SELECT *, CASE WHEN l_orderkey % 9 > 0 THEN l_returnflag END AS flag, CASE WHEN l_orderkey % 5 > 0 THEN l_linenumber / l_quantity * 100 END AS p FROM lineitem) GROUP BY flag, l_returnflag HAVING flag IS NOT NULL""")  # fmt: skip
def agg_described(load, spark):
    """Columns combined by what their values say they are: counts and money summed, a rate weighted by its fitted denominator, a mean score."""
    from ..operators.profile import described
    from .semantics import report

    rows = report(load)
    names = {"cases": "Số ca mắc", "positivity": "Tỷ lệ dương tính (%)", "budget": "Ngân sách (VND)", "score": "Điểm số"}
    out = agg.combine_described(rows, ["Nhóm"], described(rows), list(names.values())).where("`Nhóm` IS NOT NULL")
    digits = {"positivity": 6, "budget": 2, "score": 6}
    return out.select(F.col("Nhóm").alias("grp"), *((F.round(F.col(f"`{c}`"), digits[n]) if n in digits else F.col(f"`{c}`").cast("double")).alias(n) for n, c in names.items()), "n_rows")
