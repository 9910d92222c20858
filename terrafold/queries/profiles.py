"""Profiles, map options, slices and sources over the test tables."""

from pyspark.sql import functions as F

from ..operators import longform as lf
from ..operators import profile as pf
from ..sources import delimited as dl
from ..sources.boundaries import tier_roles
from ..staging import new_path
from .longform import LONG_SQL, long_table
from .registry import SQL, query
from .semantics import COLUMNS, SEMANTICS, report

PLACES = "(VALUES " + ", ".join(f"('{h}', {k})" for k, h in enumerate(COLUMNS, 1)) + ") AS o(column_name, position)"
PLAIN = "replace(strip_accents(lower(column_name)), 'đ', 'd') || ' '"
SUITS = f"CASE WHEN {' OR '.join(f'''contains({PLAIN}, '{w}')''' for w in pf.BACKGROUND)} THEN 5 ELSE 0 END + CASE WHEN semantic = 'money' THEN 3 ELSE 0 END - CASE WHEN {' OR '.join(f'''contains({PLAIN}, '{w}')''' for w in pf.OUTCOMES)} THEN 2 ELSE 0 END"


@query("map_options", f"""WITH c AS (SELECT * FROM {SEMANTICS} JOIN {PLACES} USING (column_name)),
o AS (SELECT arg_min(column_name, position) FILTER (semantic IN ('percent', 'rate-per-capita')) AS rate, arg_min(column_name, ({SUITS}, position)) FILTER (semantic IN ('count', 'money')) AS cnt, arg_min(column_name, position) FILTER (semantic = 'percentage-point') AS chg,
  arg_min(column_name, position) FILTER (semantic = 'category' AND distinct_values BETWEEN 2 AND 8) AS cat, count(*) FILTER (semantic = 'coordinate') AS axes FROM c)
SELECT 'choropleth-symbol' AS kind, 100 AS points, rate AS fill_by, cnt AS symbol_by FROM o WHERE rate IS NOT NULL AND cnt IS NOT NULL UNION ALL SELECT 'choropleth', 88, rate, NULL FROM o WHERE rate IS NOT NULL
UNION ALL SELECT 'graduated-symbol', CASE WHEN rate IS NULL THEN 84 ELSE 70 END, NULL, cnt FROM o WHERE cnt IS NOT NULL UNION ALL SELECT 'change', 80, chg, NULL FROM o WHERE chg IS NOT NULL
UNION ALL SELECT 'categorized', 74, cat, NULL FROM o WHERE cat IS NOT NULL UNION ALL SELECT 'point', 72, NULL, NULL FROM o WHERE axes = 2""")  # fmt: skip
def map_options(load, spark):
    return pf.map_options(pf.described(report(load)))


@query("year_pairs", "SELECT 'bao phủ  (%' AS indicator, 'Bao phủ 2022 (%)' AS baseline, 'Bao phủ 2026 (%)' AS comparison UNION ALL SELECT 'cases', 'cases_2024', 'Cases 2025'")
def year_pairs(load, spark):
    s = load("supplier")
    named = s.select((F.col("s_acctbal") / 100).alias("Bao phủ 2026 (%)"), (F.col("s_acctbal") / 200).alias("Bao phủ 2022 (%)"), (F.col("s_acctbal") / 300).alias("Bao phủ 2024 (%)"), F.col("s_suppkey").alias("Cases 2025"), F.col("s_suppkey").alias("cases_2024"), F.col("s_suppkey").alias("Other 2020"))
    return pf.year_pairs(pf.described(named))


@query("valid_points", "SELECT count(*) FILTER (c_custkey % 5 > 0 AND c_custkey % 7 > 0) AS drawn, count(*) FILTER (c_custkey % 5 = 0 OR c_custkey % 7 = 0) AS skipped FROM customer")
def valid_points(load, spark):
    points = load("customer").select(F.when(F.col("c_custkey") % 5 > 0, 105.0).alias("lon"), F.when(F.col("c_custkey") % 7 > 0, 16.0).alias("lat"))
    return pf.valid_points(points, "lon", "lat")[1]


@query("sample_rows", "SELECT n_name, n_regionkey FROM nation ORDER BY n_nationkey LIMIT 5")
def sample_rows(load, spark):
    return pf.sample(load("nation"), ["n_name", "n_regionkey"], columns=2, order="n_nationkey")


@query("long_top_indicators", f"""SELECT indicator, n_rows, places, (row_number() OVER (ORDER BY places DESC, n_rows DESC, indicator))::INT AS rank FROM (SELECT indicator, count(*) AS n_rows, count(DISTINCT user_id) AS places FROM {LONG_SQL} GROUP BY 1) QUALIFY rank <= 3""")
def long_top_indicators(load, spark):
    return pf.top_indicators(lf.indicator_slices(long_table(load), "indicator", "user_id", "value"), 3).select("indicator", "n_rows", "places", "rank")


@query("long_pin_warning", f"SELECT 1::BIGINT AS n_axes, 'sex' AS \"columns\", count(*) AS places FROM (SELECT user_id FROM {LONG_SQL} GROUP BY 1 HAVING count(DISTINCT sex) > 1)")
def long_pin_warning(load, spark):
    return lf.pin_warning(lf.double_counting_axes(long_table(load), "user_id", ["indicator", "sex", "period"]))


BEST_SEX = f"""(SELECT sex FROM {LONG_SQL} WHERE indicator = 'view' AND period = (SELECT max(period) FROM {LONG_SQL} WHERE indicator = 'view') GROUP BY sex ORDER BY count(DISTINCT user_id) DESC, (sex = 'Total') DESC, sum(value) DESC, sex LIMIT 1)"""


@query("long_recommend_slice", f"SELECT 'period' AS column_name, (SELECT max(period) FROM {LONG_SQL} WHERE indicator = 'view') AS pinned UNION ALL SELECT 'sex', {BEST_SEX}")
def long_recommend_slice(load, spark):
    chosen, _ = lf.recommend_slice(long_table(load), "indicator", "view", "user_id", "value", ["sex", "period"], ["period"])
    return spark.createDataFrame([(c["column"], c["pinned"]) for c in chosen], "column_name string, pinned string")


@query("long_layers", f"""SELECT user_id, round(sum(value) FILTER (indicator = 'view' AND sex = 'Male'), 4) AS "view", round(sum(value) FILTER (indicator = 'purchase') / sum(value) FILTER (indicator = 'click') * 100, 4) AS ratio FROM {LONG_SQL} GROUP BY user_id""")
def long_layers(load, spark):
    out = lf.layers(long_table(load), ["user_id"], "indicator", "value", ["view|sex=Male", "purchase / click"])
    return out.select("user_id", F.round("view", 4).alias("view"), F.round("purchase ÷ click (%)", 4).alias("ratio"))


@query("source_delimited", "SELECT n_nationkey::VARCHAR AS id, n_name AS name, CASE WHEN n_nationkey % 3 > 0 THEN n_regionkey::VARCHAR END AS region FROM nation")
def source_delimited(load, spark):
    """Written with semicolons, quotes and empty cells, and read back by what the bytes say."""
    folder = new_path(spark, "delimited")
    df = load("nation").select(F.col("n_nationkey").alias(" id "), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 3 > 0, F.col("n_regionkey")).alias("region"))
    df.coalesce(1).write.csv(folder, header=True, sep=";")
    return dl.read_delimited(spark, f"{folder}/*.csv")


@query("source_coerced", "SELECT n_nationkey, (n_nationkey * 1234 + 0.5)::DOUBLE AS amount, n_name AS label FROM nation")
def source_coerced(load, spark):
    written = F.regexp_replace(F.format_number(F.col("n_nationkey") * 1234 + 0.5, 1), r"\.5$", "") 
    text = load("nation").select("n_nationkey", F.concat(F.translate(written, ",", "."), F.lit(",5")).alias("amount"), F.col("n_name").alias("label"))
    return dl.coerced(text)[0]


@query("source_tier_roles", "SELECT * FROM (VALUES ('communes', (SELECT count(*) FROM customer), 'commune'), ('provinces', (SELECT count(*) FROM nation), 'province'), ('outline', 1, NULL)) t(tier, units, role)")
def source_tier_roles(load, spark):
    one = lambda name, df: df.agg(F.lit(name).alias("tier"), F.count("*").alias("units"))
    tiers = one("communes", load("customer")).union(one("provinces", load("nation"))).union(one("outline", load("nation").where("n_nationkey = 0")))
    return tier_roles(tiers)


# A denominator that arithmetic proves goes before one by name.
WEIGHTS = f"SELECT rate, coalesce(f.denominator, n.denominator) AS weight FROM ({SQL['denominator_by_name']}) n LEFT JOIN ({SQL['fit_denominator']}) f USING (rate)"


@query("profile", f"""WITH k AS (SELECT * FROM {SEMANTICS} JOIN {PLACES} USING (column_name))
SELECT 'column' AS part, column_name AS item, semantic AS detail FROM k UNION ALL SELECT 'weight', rate, weight FROM ({WEIGHTS}) WHERE weight IS NOT NULL UNION ALL SELECT 'option', kind, points::VARCHAR FROM ({SQL['map_options']})
UNION ALL SELECT 'place', 'Nhóm', 'province 1' UNION ALL SELECT 'period', column_name, NULL FROM k WHERE semantic = 'time'
UNION ALL SELECT 'coordinate', column_name, CASE column_name WHEN 'Kinh độ' THEN 'lon' ELSE 'lat' END FROM k WHERE semantic = 'coordinate'
UNION ALL SELECT 'warning', column_name, 'several-periods' FROM k WHERE semantic = 'time' AND distinct_values > 1
UNION ALL SELECT 'warning', column_name, 'percent-over-100' FROM k WHERE semantic = 'percent' AND hi * CASE WHEN hi <= 1.5 THEN 100 ELSE 1 END > 100.5
UNION ALL SELECT 'warning', column_name, 'percent-negative' FROM k WHERE semantic = 'percent' AND lo < 0
UNION ALL SELECT 'warning', column_name, 'mostly-missing' FROM k WHERE 1 - present / n_rows >= 0.4 AND semantic NOT IN ('time', 'identifier', 'text', 'coordinate')""")  # fmt: skip
def profile(load, spark):
    """All that is to be said of a report before a map is drawn: line items, whose return flags pass for provinces."""
    from ..functions.text import normalize
    from .matching import VIETNAM

    flags = load("lineitem").select(normalize(F.col("l_returnflag"), VIETNAM).alias("key")).distinct()
    return pf.profile(report(load), flags, None, VIETNAM).summary()
