"""Breaks, classes, legends, symbols and category scales."""

from pyspark.sql import functions as F

from ..operators import classify as cl
from .registry import query


def edges_frame(spark, bins):
    rows = [(i, float(f"{a:.6f}"), float(f"{b:.6f}")) for i, (a, b) in enumerate(zip(bins.edges, bins.edges[1:]))]
    return spark.createDataFrame(rows, "class_idx int, lo double, hi double")


def per_nation(load):
    return load("customer").groupBy("c_nationkey").agg(F.round(F.sum("c_acctbal"), 2).alias("v"), F.count("*").alias("n"))


UNITS = "(SELECT c_nationkey, round(sum(c_acctbal), 2) AS v, count(*) AS n FROM customer GROUP BY 1)"
# The fold over few edges as lists: slivers first, then the last class; quantiles and equal steps of many values leave none empty.
COLLAPSE = """kept AS (SELECT list_reduce(e[2:len(e) - 1], lambda a, x: CASE WHEN x - a[len(a)] < greatest((e[len(e)] - e[1]) * 0.04, w) THEN a ELSE list_append(a, x) END, [e[1]]) AS a, e[len(e)] AS z, greatest((e[len(e)] - e[1]) * 0.04, w) AS w FROM raw),
edges AS (SELECT list_append(CASE WHEN len(a) > 1 AND z - a[len(a)] < w THEN a[1:len(a) - 1] ELSE a END, z) AS e FROM kept),
bins AS (SELECT i::INT - 1 AS class_idx, round(e[i], 6) AS lo, round(e[i + 1], 6) AS hi FROM (SELECT e, unnest(range(1, len(e))) AS i FROM edges))"""


def quantile_sql(values: str, k: int) -> str:
    at = ", ".join(f"{i / k!r}" for i in range(1, k))
    return f"raw AS (SELECT list_concat(list_concat([min(v)], quantile_cont(v, [{at}])), [max(v)]) AS e, 0.0 AS w FROM {values}), {COLLAPSE}"


@query("bins_quantile", f"WITH {quantile_sql('(SELECT o_totalprice AS v FROM orders)', 5)} SELECT * FROM bins")
def bins_quantile(load, spark):
    return edges_frame(spark, cl.compute_bins(load("orders"), "o_totalprice", "quantile", 5))


@query("bins_equal_interval", f"""WITH s AS (SELECT min(c_acctbal) AS a, max(c_acctbal) AS z FROM customer), raw AS (SELECT list_transform(range(0, 7), lambda i: a + (z - a) / 6 * i) AS e, 0.0 AS w FROM s), {COLLAPSE} SELECT * FROM bins""")
def bins_equal_interval(load, spark):
    return edges_frame(spark, cl.compute_bins(load("customer"), "c_acctbal", "equal-interval", 6))


@query("bins_integer_snap", f"""WITH q AS (SELECT min(n) AS a, quantile_cont(n, [0.2, 0.4, 0.6, 0.8]) AS m, max(n) AS z FROM {UNITS}),
raw AS (SELECT list_sort(list_distinct(list_concat(list_concat([floor(a)::DOUBLE], list_transform(m, lambda x: round_even(x, 0)::DOUBLE)), [ceil(z)::DOUBLE]))) AS e, 1.0 AS w FROM q), {COLLAPSE} SELECT * FROM bins""")  # fmt: skip
def bins_integer_snap(load, spark):
    return edges_frame(spark, cl.compute_bins(per_nation(load), "n", "quantile", 5, integer=True))


@query("bins_collapse", f"WITH {quantile_sql('(SELECT v FROM ' + UNITS + ' UNION ALL SELECT 1e9)', 7)} SELECT * FROM bins")
def bins_collapse(load, spark):
    """An outlier makes slivers of most quantiles."""
    far = per_nation(load).select("v").union(spark.range(1).select(F.lit(1e9)))
    return edges_frame(spark, cl.compute_bins(far, "v", "quantile", 7))


SERIES = "(SELECT c_mktsegment, c_nationkey, sum(c_acctbal) AS v FROM customer GROUP BY ALL)"


def series(load):
    return load("customer").groupBy("c_mktsegment", "c_nationkey").agg(F.sum("c_acctbal").alias("v"))


@query("bins_shared", f"""WITH {quantile_sql(SERIES, 5)}, x AS (SELECT *, least((SELECT count(*) FROM bins WHERE v > hi + 1e-9), (SELECT count(*) FROM bins) - 1)::INT AS class_idx FROM {SERIES})
SELECT c_mktsegment, class_idx, count(*) AS units FROM x GROUP BY ALL""")  # fmt: skip
def bins_shared(load, spark):
    rows = series(load)
    return cl.classified(rows, "v", cl.compute_bins(rows, "v", "quantile", 5)).groupBy("c_mktsegment", "class_idx").agg(F.count("*").alias("units"))


@query("change_diverging_bins", """WITH q AS (SELECT min(c_acctbal) AS a, quantile_cont(c_acctbal, [0.5]) FILTER (c_acctbal < 0) AS n, quantile_cont(c_acctbal, [0.5]) FILTER (c_acctbal > 0) AS p, max(c_acctbal) AS z FROM customer),
e AS (SELECT list_sort(list_distinct([a, n[1], 0.0, p[1], z])) AS e FROM q) SELECT i::INT - 1 AS class_idx, round(e[i], 6) AS lo, round(e[i + 1], 6) AS hi FROM (SELECT e, unnest(range(1, len(e))) AS i FROM e)""")  # fmt: skip
def change_diverging_bins(load, spark):
    return edges_frame(spark, cl.compute_bins(load("customer"), "c_acctbal", "quantile", 5, center_zero=True))


def natural_sql(rows: str, cuts: int) -> str:
    """Every way to cut the distinct values of ``rows(v)``, tried: the one with the least squared deviation."""
    names = [f"i{k}" for k in range(1, cuts + 1)]
    ends = ["0", *names, "n"]
    sse = lambda a, b: f"(q[{b} + 1] - q[{a} + 1] - pow(s[{b} + 1] - s[{a} + 1], 2) / (w[{b} + 1] - w[{a} + 1]))"
    ways = " ".join(f", range(1, n) r{k}({name})" for k, name in enumerate(names))
    return f"""WITH d AS (SELECT v, count(*) AS c FROM ({rows}) GROUP BY v), p AS (SELECT v, sum(c) OVER u AS w, sum(c * v) OVER u AS s, sum(c * v * v) OVER u AS q FROM d WINDOW u AS (ORDER BY v)),
l AS (SELECT list(v ORDER BY v) AS v, list_concat([0.0], list(w::DOUBLE ORDER BY v)) AS w, list_concat([0.0], list(s::DOUBLE ORDER BY v)) AS s, list_concat([0.0], list(q::DOUBLE ORDER BY v)) AS q, count(*) AS n FROM p),
t AS (SELECT l.v, n, {", ".join(names)}, {" + ".join(sse(x, y) for x, y in zip(ends, ends[1:]))} AS cost FROM l{ways} WHERE {" AND ".join(f"{x} < {y}" for x, y in zip(names, names[1:]))}),
raw AS (SELECT arg_min([v[1], {", ".join(f"v[{x}]" for x in names)}, v[n]], cost) AS e, 0.0 AS w FROM t), {COLLAPSE} SELECT * FROM bins"""


@query("bins_natural_breaks", natural_sql(f"SELECT v::DOUBLE AS v FROM {UNITS}", 3))
def bins_natural_breaks(load, spark):
    return edges_frame(spark, cl.compute_bins(per_nation(load), "v", "natural-breaks", 4))


@query("bins_natural_quantities", natural_sql("SELECT l_quantity::DOUBLE AS v FROM lineitem", 3))
def bins_natural_quantities(load, spark):
    return edges_frame(spark, cl.compute_bins(load("lineitem"), "l_quantity", "natural-breaks", 4))


@query("bins_natural_prices")
def bins_natural_prices(load, spark):
    """Tens of thousands of distinct values, in blocks; tested against plain dynamic programming."""
    return edges_frame(spark, cl.compute_bins(load("lineitem"), "l_extendedprice", "natural-breaks", 5))


EDGES = [0.0, 1000.0, 5000.0, 9000.0, 20000.0]


@query("class_index", "SELECT c_custkey, ((c_acctbal > 1000 + 1e-9)::INT + (c_acctbal > 5000 + 1e-9)::INT + (c_acctbal > 9000 + 1e-9)::INT)::INT AS class_idx FROM customer")
def class_index(load, spark):
    return load("customer").select("c_custkey", cl.class_index(F.col("c_acctbal"), EDGES).alias("class_idx"))


LEGEND_SQL = f"""WITH {quantile_sql(UNITS, 5)}, n AS (SELECT count(*) AS k FROM bins),
d AS (SELECT min(x) AS d FROM range(0, 7) r(x), (SELECT max(hi) - min(lo) AS span FROM bins) WHERE x >= CASE WHEN span >= 20 THEN 0 WHEN span >= 2 THEN 1 ELSE 2 END),
u AS (SELECT least((SELECT count(*) FROM bins WHERE v > hi + 1e-9), (SELECT k FROM n) - 1)::INT AS class_idx, count(*) AS n_units FROM {UNITS} GROUP BY 1)
SELECT bins.class_idx, lo, hi, format('{{:,.0f}}', lo) || '–' || format('{{:,.0f}}', hi) AS label, coalesce(n_units, 0) AS n_units FROM bins LEFT JOIN u USING (class_idx)"""


@query("bin_labels", LEGEND_SQL)
def bin_labels(load, spark):
    rows = per_nation(load)
    bins = cl.compute_bins(rows, "v", "quantile", 5)
    return cl.legend(rows, "v", bins).select("class_idx", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "label", "n_units")


@query("symbol_radii", f"SELECT c_nationkey, round(CASE WHEN v > 0 THEN greatest(0.0022, 0.021 * sqrt(least(v / (SELECT max(v) FROM {UNITS}), 1.0))) END, 8) AS radius FROM {UNITS}")
def symbol_radii(load, spark):
    rows = per_nation(load)
    most = rows.agg(F.max("v").alias("m")).first().m
    return rows.select("c_nationkey", F.round(cl.radius(F.col("v"), most), 8).alias("radius"))


@query("category_order", """SELECT label, ord::INT AS ord, colour, true AS known FROM (VALUES ('Thấp', 0, '#cfe6f7'), ('Trung bình', 1, '#5d9fd0'), ('Cao', 2, '#005eaa')) t(label, ord, colour)""")
def category_order(load, spark):
    labels = load("orders").select(F.element_at(F.array(F.lit("Cao"), F.lit("Thấp"), F.lit("Trung bình")), (F.col("o_orderkey") % 3).cast("int") + 1).alias("level"))
    return cl.category_order(labels, "level").withColumn("ord", F.col("ord").cast("int"))


@query("category_ranked", "SELECT o_orderpriority AS label, (row_number() OVER (ORDER BY o_orderpriority) - 1)::INT AS ord, true AS known FROM (SELECT DISTINCT o_orderpriority FROM orders)")
def category_ranked(load, spark):
    return cl.category_order(load("orders"), "o_orderpriority").select("label", F.col("ord").cast("int").alias("ord"), "known")


@query("category_unordered", """SELECT c_mktsegment AS label, (k - 1)::INT AS ord, ['#005eaa', '#497d0c', '#00695c', '#fbab18', '#af4448', '#712177', '#29434e', '#bb4d00'][((k - 1) % 8 + 1)::INT] AS colour, false AS known
FROM (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) AS k FROM (SELECT DISTINCT c_mktsegment FROM customer))""")  # fmt: skip
def category_unordered(load, spark):
    return cl.category_order(load("customer"), "c_mktsegment").withColumn("ord", F.col("ord").cast("int"))


@query("stated_order", """SELECT o_orderstatus AS label, (row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'F' THEN 1 ELSE 2 END, o_orderstatus) - 1)::INT AS ord FROM (SELECT DISTINCT o_orderstatus FROM orders)""")
def stated_order(load, spark):
    return cl.category_order(load("orders"), "o_orderstatus", stated=["P", "F"]).select("label", F.col("ord").cast("int").alias("ord"))
