"""One query for each safety check, on data that trips it."""

from pyspark.sql import functions as F

from ..operators import checks as ck
from ..operators import classify as cl
from . import classes as qc
from . import matching as qm
from .geography import MASSES, far_region, geo
from .registry import query

EMPTY = "SELECT NULL::VARCHAR AS id, NULL::VARCHAR AS severity, NULL::VARCHAR AS \"column\", NULL::DOUBLE AS metric WHERE false"


def row(key: str, severity: str, column: str, metric: str, source: str = "", where: str = "true") -> str:
    return f"SELECT '{key}' AS id, {severity} AS severity, '{column}' AS \"column\", round(({metric})::DOUBLE, 6) AS metric {source} WHERE {where}"


def shown(df):
    return df.select("id", "severity", "column", F.round("metric", 6).alias("metric"))


@query("check_low_coverage", row("low-coverage", "CASE WHEN s < 0.15 THEN 'critical' ELSE 'warning' END", "value", "s", "FROM (SELECT count(*) FILTER (n_nationkey % 5 = 0) / count(*) AS s FROM nation)", "s < 0.35"))
def check_low_coverage(load, spark):
    frame = load("nation").select(F.when(F.col("n_nationkey") % 5 == 0, 1.0).alias("value"))
    return shown(ck.check_coverage(frame, "value"))


DUPES = "FROM (SELECT count(*) AS n FROM (SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING count(*) > 1))"
for _key, _severity, _method, _weighted in (("summing-a-rate", "critical", "sum", False), ("unweighted-mean", "warning", "mean", False), ("weight-guessed", "warning", "weighted-mean", True)):

    @query("check_" + _key.replace("-", "_"), row(_key, f"'{_severity}'", "l_discount", "n", DUPES, "n > 0"))
    def check_combining(load, spark, key=_key, method=_method, weighted=_weighted):
        found = ck.check_aggregation(load("lineitem"), ["l_suppkey"], "l_discount", "percent", method, weighted)
        return shown(ck.ranked(found).where(F.col("id") == key))


@query("check_colour_by_count", row("colour-by-count", "'warning'", "n", "n", "FROM (SELECT count(DISTINCT c_nationkey) AS n FROM customer)"))
def check_colour_by_count(load, spark):
    return shown(ck.check_colour_choice(qc.per_nation(load), "n", "count", "choropleth"))


PCT = "FROM (SELECT max(l_quantity * 3) AS hi, min(l_quantity * 3 - 20) AS lo FROM lineitem)"


@query("check_percent_over_100", row("percent-over-100", "'warning'", "p", "hi", "FROM (SELECT max(l_quantity * 3 - 20) AS hi FROM lineitem)", "hi > 100.5"))
def check_percent_over_100(load, spark):
    return shown(ck.check_percent_range(load("lineitem").select((F.col("l_quantity") * 3 - 20).alias("p")), "p")[0])


@query("check_percent_negative", row("percent-negative", "'warning'", "p", "lo", "FROM (SELECT min(l_quantity * 3 - 20) AS lo FROM lineitem)", "lo < 0"))
def check_percent_negative(load, spark):
    return shown(ck.check_percent_range(load("lineitem").select((F.col("l_quantity") * 3 - 20).alias("p")), "p")[1])


@query("check_classes_adjusted", row("classes-adjusted", "'info'", "k", "2"))
def check_classes_adjusted(load, spark):
    rows = load("nation").select((F.col("n_nationkey") % 2).cast("double").alias("k"))
    return shown(ck.check_classes(rows, "k", cl.compute_bins(rows, "k", "equal-interval", 5))[0])


@query("check_too_many_classes", row("too-many-classes", "'warning'", "k", "5", "FROM (SELECT count(*) AS n FROM region)", "5 > greatest(2, n // 3)"))
def check_too_many_classes(load, spark):
    rows = load("region").select(F.col("r_regionkey").cast("double").alias("k"))
    return shown(ck.check_classes(rows, "k", cl.compute_bins(rows, "k", "equal-interval", 5))[1])


@query("check_spread_too_small", row("spread-too-small", "'warning'", "k", "s", "FROM (SELECT (max(k) - min(k)) / max(k) AS s FROM (SELECT 1000.0 + n_nationkey / 10.0 AS k FROM nation))", "s <= 0.02"))
def check_spread_too_small(load, spark):
    rows = load("nation").select((F.lit(1000.0) + F.col("n_nationkey") / 10.0).alias("k"))
    return shown(ck.check_classes(rows, "k", cl.compute_bins(rows, "k", "equal-interval", 4))[2])


@query("check_needs_diverging_scale", row("needs-diverging-scale", "'info'", "c_acctbal", "lo", "FROM (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)", "lo < 0 AND hi > 0"))
def check_needs_diverging_scale(load, spark):
    return shown(ck.check_diverging(load("customer"), "c_acctbal"))


REVIEWED = f"FROM (SELECT count(*) AS total, count(*) FILTER (match_method = 'unmatched') AS unmatched FROM ({qm.REVIEW_SQL}))"


@query("check_unmatched_rows", row("unmatched-rows", "'critical'", "", "unmatched", REVIEWED, "unmatched > 0"))
def check_unmatched_rows(load, spark):
    return shown(ck.ranked(ck.check_matching(qm.match_summary(load, spark))))


@query("check_merger_converted", row("merger-converted", "'info'", "", "n", "FROM (SELECT count(*) AS n FROM nation)"))
def check_merger_converted(load, spark):
    reviewed = qm.match_merged(load, spark).select(F.col("method").alias("match_method"), F.lit("high-confidence").alias("status"))
    return shown(ck.ranked(ck.check_matching(qm.mt.summarize(reviewed))))


@query("check_ambiguous_match", row("ambiguous-match", "'critical'", "", "3"))
def check_ambiguous_match(load, spark):
    reviewed = qm.match_ambiguous(load, spark).select(F.col("method").alias("match_method"), F.lit("needs-review").alias("status"))
    return shown(ck.ranked(ck.check_matching(qm.mt.summarize(reviewed))))


@query("check_match_needs_review", row("match-needs-review", "'warning'", "", "n", f"FROM (SELECT count(*) AS n FROM ({qm.FUZZY_SQL}))"))
def check_match_needs_review(load, spark):
    reviewed = qm.match_fuzzy(load, spark).select(F.lit("fuzzy").alias("match_method"), F.lit("needs-review").alias("status"))
    return shown(ck.ranked(ck.check_matching(qm.mt.summarize(reviewed))))


@query("check_may_not_be_commune_level", row("may-not-be-commune-level", "'critical'", "", "s", "FROM (SELECT count(*) AS n, count(*) FILTER (n_nationkey % 4 = 0) / count(*) AS s FROM nation)", "n >= 10 AND s >= 0.15"))
def check_may_not_be_commune_level(load, spark):
    reviewed = load("nation").select(F.when(F.col("n_nationkey") % 4 == 0, "unmatched").otherwise("exact").alias("match_method"), F.when(F.col("n_nationkey") % 4 == 0, "unmatched").otherwise("high-confidence").alias("status"))
    return shown(ck.check_admin_level(qm.mt.summarize(reviewed)))


@query("check_several_periods", row("several-periods", "'critical'", "year", "n", "FROM (SELECT count(DISTINCT year(o_orderdate)) AS n FROM orders)", "n > 1"))
def check_several_periods(load, spark):
    return shown(ck.check_periods(load("orders").select(F.year("o_orderdate").alias("year")), "year"))


@query("check_categories_not_ordered", row("categories-not-ordered", "'warning'", "", "n", "FROM (SELECT count(DISTINCT c_mktsegment) AS n FROM customer)", "n >= 3"))
def check_categories_not_ordered(load, spark):
    return shown(ck.check_category_order(cl.category_order(load("customer"), "c_mktsegment")))


@query("check_circles_hide_areas", row("circles-hide-areas", "'warning'", "width", "0.08 / w", "FROM (SELECT median(1 / (1 + sqrt(n))) AS w FROM (SELECT count(*) AS n FROM supplier GROUP BY s_nationkey))", "0.08 > 1.6 * w"))
def check_circles_hide_areas(load, spark):
    widths = load("supplier").groupBy("s_nationkey").agg((1 / (1 + F.sqrt(F.count("*")))).alias("width"))
    return shown(ck.check_occlusion(widths, "width", 0.04))


@query("check_circles_leave_areas", EMPTY)
def check_circles_leave_areas(load, spark):
    """Circles far smaller than the units say nothing."""
    widths = load("supplier").groupBy("s_nationkey").agg((10 + F.count("*")).alias("width"))
    return shown(ck.check_occlusion(widths, "width", 0.04))


@query("check_few_labels", row("few-labels", "CASE WHEN s < 0.25 THEN 'critical' ELSE 'warning' END", "", "s", "FROM (SELECT least(45, count(*)) / count(*) AS s FROM customer)", "s < 0.6"))
def check_few_labels(load, spark):
    return shown(ck.check_labels(load("customer")))


MAIN_SHARE = "FROM (SELECT arg_max(width, (area, width)) / (SELECT max(x) + 1 - min(x) FROM s) AS s FROM g)"


@query("check_detached_land_no_inset", MASSES + row("detached-land-no-inset", "CASE WHEN s < 0.5 THEN 'critical' ELSE 'warning' END", "", "s", MAIN_SHARE, "s < 0.8"))
def check_detached_land_no_inset(load, spark):
    return shown(ck.check_detached(geo.land_report(geo.land_masses(far_region(load), 0.1))))


@query("check_mostly_missing", row("mostly-missing", "'warning'", "big", "s", "FROM (SELECT count(*) FILTER (o_totalprice <= 200000) / count(*) AS s FROM orders)", "s >= 0.4"))
def check_mostly_missing(load, spark):
    rows = load("orders").select(F.when(F.col("o_totalprice") > 200000, F.col("o_totalprice")).alias("big"), "o_orderstatus")
    return shown(ck.check_missing(rows, ["big", "o_orderstatus"]))


@query("check_unreadable_periods", row("unreadable-periods", "'warning'", "period", "1"))
def check_unreadable_periods(load, spark):
    from .text import _periods

    return shown(ck.check_unreadable_periods(_periods(load), "period"))


@query("check_long_table_double_count", row("long-table-double-count", "'critical'", "sex", "n", "FROM (SELECT count(DISTINCT user_id) AS n FROM events)"))
def check_long_table_double_count(load, spark):
    from .longform import lf, long_table

    return shown(ck.check_double_count(lf.double_counting_axes(long_table(load), "user_id", ["indicator", "sex", "period"])))


@query("check_sheet_not_mappable", row("sheet-not-mappable", "'critical'", "", "n", "FROM (SELECT count(*) AS n FROM orders)"))
def check_sheet_not_mappable(load, spark):
    from .grids import gr

    return shown(ck.check_sheet(gr.usability(load("orders"), None)))


@query("issue_ranking", """SELECT * FROM (VALUES ('summing-a-rate', 'critical', 1), ('needs-diverging-scale', 'info', 3)) t(id, severity, rank)""")
def issue_ranking(load, spark):
    found = [ck.check_diverging(load("customer"), "c_acctbal"), *ck.check_aggregation(load("lineitem"), ["l_suppkey"], "l_discount", "percent", "sum")]
    return ck.ranked(found).select("id", "severity", F.col("rank").cast("int").alias("rank"))
