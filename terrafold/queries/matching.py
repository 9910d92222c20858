"""Names against units: joins, reviews, crosswalks, discovery."""

from pyspark.sql import functions as F

from ..functions.text import VIETNAM, normalize
from ..operators import matching as mt
from ..operators.scope import contexts
from ..sources.remembered import store_overrides, stored_overrides
from ..staging import new_path
from .registry import query
from .text import normalize_sql

UNITS = "SELECT n_nationkey AS shape_id, 'Xứ ' || n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey"
ROWS = """CASE c_custkey % 6 WHEN 0 THEN 'Xứ ' || n_name WHEN 1 THEN 'Tỉnh Xứ ' || n_name WHEN 2 THEN 'xu ' || lower(n_name) WHEN 3 THEN 'XỨ-' || n_name || ' Province' WHEN 4 THEN 'Nơi khác' ELSE '  ' END"""
KEY_NAME, KEY_RAW = normalize_sql("name"), normalize_sql("raw")


def _units(load):
    return load("nation").join(load("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("shape_id"), F.concat(F.lit("Xứ "), "n_name").alias("name"), F.col("r_name").alias("region"))


def _rows(load):
    return load("customer").join(load("nation"), F.col("c_nationkey") == F.col("n_nationkey")).withColumn("place", F.expr(ROWS))


def _index(load):
    return mt.name_index(_units(load), VIETNAM)


REVIEW_SQL = f"""WITH u AS ({UNITS}), r AS (SELECT trim({ROWS}) AS raw, count(*) AS row_count FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
j AS (SELECT r.raw, r.row_count, u.shape_id, u.name FROM r LEFT JOIN u ON {KEY_RAW} = {KEY_NAME}),
m AS (SELECT raw, row_count, min(shape_id) AS shape_id, min(name) AS name, max((name = raw)::INT) AS literal FROM j GROUP BY raw, row_count)
SELECT raw AS dataset_province, coalesce(name, '') AS matched_province, CASE WHEN name IS NULL THEN 0.0::DOUBLE ELSE 100.0::DOUBLE END AS province_score,
CASE WHEN name IS NULL THEN 'unmatched' WHEN literal = 1 THEN 'exact' ELSE 'normalised' END AS match_method, CASE WHEN name IS NULL THEN 'unmatched' ELSE 'high-confidence' END AS status, shape_id, '' AS candidates, row_count FROM m"""


@query("match_review", REVIEW_SQL)
def match_review(load, spark):
    return mt.review(_rows(load), "place", _index(load), VIETNAM, fuzzy=False)


@query("match_summary", f"""SELECT count(*) AS total, count(*) FILTER (status = 'high-confidence') AS high_confidence, count(*) FILTER (status = 'needs-review') AS needs_review, count(*) FILTER (status = 'unmatched') AS unmatched,
count(*) FILTER (match_method = 'exact') AS by_exact, count(*) FILTER (match_method = 'normalised') AS by_normalised, count(*) FILTER (match_method = 'ambiguous') AS by_ambiguous, count(*) FILTER (match_method = 'merged') AS by_merged,
count(*) FILTER (match_method = 'fuzzy') AS by_fuzzy, count(*) FILTER (match_method = 'override') AS by_override FROM ({REVIEW_SQL})""")  # fmt: skip
def match_summary(load, spark):
    return mt.summarize(match_review(load, spark))


for _method in ("exact", "normalised"):

    @query(f"match_{_method}", f"SELECT dataset_province, shape_id, row_count FROM ({REVIEW_SQL}) WHERE match_method = '{_method}'")
    def match_method(load, spark, method=_method):
        return match_review(load, spark).where(F.col("match_method") == method).select("dataset_province", "shape_id", "row_count")


@query("match_attach", f"SELECT shape_id, count(*) AS n_rows, round(sum(c_acctbal), 2) AS total FROM (SELECT *, trim({ROWS}) AS raw FROM customer JOIN nation ON c_nationkey = n_nationkey) JOIN ({UNITS}) u ON {KEY_RAW} = {KEY_NAME} GROUP BY shape_id")
def match_attach(load, spark):
    rows = mt.attach_shapes(_rows(load), "place", match_review(load, spark))
    return rows.groupBy("shape_id").agg(F.count("*").alias("n_rows"), F.round(F.sum("c_acctbal"), 2).alias("total"))


AMBIGUOUS = "regexp_replace(n_name, '[0-9]+', '') || CAST(n_nationkey % 3 AS {})"


@query("match_ambiguous", f"""WITH u AS (SELECT n_nationkey AS shape_id, CASE WHEN n_nationkey % 2 = 0 THEN upper(x) ELSE lower(x) END || repeat('.', (n_nationkey // 6)::INT) AS name FROM (SELECT *, {AMBIGUOUS.format('VARCHAR')} AS x FROM nation)),
k AS (SELECT *, {KEY_NAME} AS key FROM u), r AS (SELECT DISTINCT key || ' city' AS raw, key FROM k)
SELECT r.raw, 'ambiguous' AS method, min(shape_id) AS shape_id, array_to_string(list_sort(list(DISTINCT name)), '; ') AS candidates FROM r JOIN k USING (key) GROUP BY r.raw HAVING count(DISTINCT name) > 1""")  # fmt: skip
def match_ambiguous(load, spark):
    x = F.expr(AMBIGUOUS.format("STRING"))
    units = load("nation").select(F.col("n_nationkey").alias("shape_id"), F.concat(F.when(F.col("n_nationkey") % 2 == 0, F.upper(x)).otherwise(F.lower(x)), F.expr("repeat('.', CAST(n_nationkey div 6 AS INT))")).alias("name"))
    index = mt.name_index(units, VIETNAM)
    names = index.select(F.concat("key", F.lit(" city")).alias("raw")).distinct()
    return mt.match_names(names, index, VIETNAM).where("method = 'ambiguous'").select("raw", "method", "shape_id", "candidates")


MERGERS = "SELECT r_regionkey AS shape_id, r_name AS current, array_to_string(list_sort(list(n_name)), ', ') AS merger FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL"


def _mergers(load):
    per = load("nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ", ").alias("merger"))
    return load("region").join(per, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_regionkey").alias("shape_id"), F.col("r_name").alias("current"), "merger")


@query("crosswalk_build", f"SELECT n_name AS former, current FROM ({MERGERS}) m JOIN nation ON n_regionkey = shape_id")
def crosswalk_build(load, spark):
    return mt.crosswalk(_mergers(load), "current", "merger")


@query("match_merged", """SELECT 'Tỉnh ' || n_name AS raw, 'merged' AS method, n_regionkey AS shape_id, r_name AS matched FROM nation JOIN region ON n_regionkey = r_regionkey""")
def match_merged(load, spark):
    index = mt.name_index(mt.crosswalk_units(_mergers(load), "current", "merger", "shape_id", VIETNAM), VIETNAM)
    names = load("nation").select(F.concat(F.lit("Tỉnh "), "n_name").alias("raw"))
    return mt.match_names(names, index, VIETNAM).select("raw", "method", "shape_id", "matched")


@query("crosswalk_resolve", """SELECT r_name AS current, count(*) AS n_rows, round(sum(c_acctbal), 2) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def crosswalk_resolve(load, spark):
    rows = load("customer").join(load("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("former"), "c_acctbal")
    return rows.join(mt.crosswalk(_mergers(load), "current", "merger"), "former").groupBy("current").agg(F.count("*").alias("n_rows"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("crosswalk_summary", "SELECT count(*) AS converted, count(DISTINCT n_regionkey) AS targets FROM nation")
def crosswalk_summary(load, spark):
    return match_merged(load, spark).where("method = 'merged'").agg(F.count("*").alias("converted"), F.countDistinct("shape_id").alias("targets"))


NESTED = "SELECT 'Region of ' || r_name AS p, 'District ' || n_name AS raw, r_name, n_name, n_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def _nested(load):
    from ..functions.text import affix_pattern_of

    words = affix_pattern_of(["Region", "District"])
    both = load("nation").join(load("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = load("customer").join(both, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("Region of "), "r_name").alias("p"), F.concat(F.lit("District "), "n_name").alias("c"))
    coarse = mt.name_index(load("region").select(F.col("r_regionkey").alias("shape_id"), F.col("r_name").alias("name")), words)
    fine = mt.name_index(both.select(F.col("n_nationkey").alias("shape_id"), F.col("n_name").alias("name"), F.col("r_name").alias("region")), words, parent="region")
    return words, rows, coarse, fine


@query("match_hierarchical", f"SELECT p AS dataset_province, raw AS dataset_commune, r_name AS matched_province, n_name AS matched_commune, 100.0::DOUBLE AS match_score, 'normalised' AS match_method, n_nationkey AS shape_id, count(*) AS row_count FROM ({NESTED}) GROUP BY ALL")
def match_hierarchical(load, spark):
    words, rows, coarse, fine = _nested(load)
    out = mt.review_nested(rows, "p", "c", coarse, fine, words)
    return out.select("dataset_province", "dataset_commune", "matched_province", "matched_commune", "match_score", "match_method", "shape_id", "row_count")


OVERRIDDEN = f"SELECT p AS dataset_province, raw AS dataset_commune, CASE WHEN n_nationkey = 3 THEN 'override' ELSE 'normalised' END AS match_method, CASE WHEN n_nationkey = 3 THEN 7 ELSE n_nationkey END AS shape_id, count(*) AS row_count FROM ({NESTED}) GROUP BY ALL"


@query("match_override", OVERRIDDEN)
def match_override(load, spark):
    words, rows, coarse, fine = _nested(load)
    both = load("nation").join(load("region"), F.col("n_regionkey") == F.col("r_regionkey")).where("n_nationkey = 3")
    manual = both.select(F.col("r_name").alias("coarse"), F.concat(F.lit("district "), F.lower("n_name")).alias("fine"), F.lit(7).alias("shape_id"), F.lit("by hand").alias("matched"))
    return mt.review_nested(rows, "p", "c", coarse, fine, words, manual).select("dataset_province", "dataset_commune", "match_method", "shape_id", "row_count")


@query("match_stored_override", OVERRIDDEN)
def match_stored_override(load, spark):
    """Decisions as an earlier run stored them, the last of two counts."""
    words, rows, coarse, fine = _nested(load)
    both = load("nation").join(load("region"), F.col("n_regionkey") == F.col("r_regionkey")).where("n_nationkey = 3")
    store = new_path(spark, "overrides")
    for at, unit in ((1, 5), (2, 7)):
        store_overrides(both.select(F.col("r_name").alias("coarse"), F.concat(F.lit("District "), "n_name").alias("fine"), F.lit(unit).alias("shape_id"), F.lit("by hand").alias("matched"), F.lit(at).alias("at")), store)
    out = mt.review_nested(rows, "p", "c", coarse, fine, words, stored_overrides(spark, store))
    return out.select("dataset_province", "dataset_commune", "match_method", F.col("shape_id").cast("int").alias("shape_id"), "row_count")


@query("match_status", """SELECT o_orderkey, CASE WHEN k = 0 THEN 'unmatched' WHEN k = 1 THEN 'needs-review' WHEN k = 2 THEN CASE WHEN s < 93 OR t < 90 THEN 'needs-review' ELSE 'high-confidence' END ELSE CASE WHEN t < 90 THEN 'needs-review' ELSE 'high-confidence' END END AS status
FROM (SELECT o_orderkey, o_orderkey % 4 AS k, 80.0 + o_orderkey % 20 AS s, 80.0 + o_custkey % 20 AS t FROM orders)""")  # fmt: skip
def match_status(load, spark):
    method = F.expr("element_at(array('unmatched', 'ambiguous', 'fuzzy', 'exact'), CAST(o_orderkey % 4 AS INT) + 1)")
    return load("orders").select("o_orderkey", mt.status_for(method, F.expr("80.0 + o_orderkey % 20"), F.expr("80.0 + o_custkey % 20")).alias("status"))


# Longest common subsequences by rows of the usual table, for every name and unit.
FUZZY_SQL = """WITH u AS (SELECT n_nationkey AS shape_id, n_name || ' ' || r_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey),
r AS (SELECT substr(name, 1, 5) || 'x' || substr(name, 6) AS raw FROM u UNION ALL SELECT r_name || ' ' || n_name || 'Y' FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT substr(name, 1, 3) FROM u),
k AS (SELECT DISTINCT raw, trim(regexp_replace(lower(raw), '\\s+', ' ', 'g')) AS a FROM r), i AS (SELECT shape_id, name, lower(name) AS b FROM u),
p AS (SELECT raw, shape_id, name, unnest([[a, b], [array_to_string(list_sort(string_split(a, ' ')), ' '), array_to_string(list_sort(string_split(b, ' ')), ' ')]]) AS t FROM k, i),
l AS (SELECT raw, shape_id, name, 200.0 * list_last(list_reduce(string_split(t[1], ''), lambda w, c: list_reduce(range(1, len(t[2]) + 1), lambda x, j: list_append(x, CASE WHEN substr(t[2], j, 1) = c THEN w[j] + 1 ELSE greatest(w[j + 1], x[j]) END), [0]::BIGINT[]), list_transform(range(0, len(t[2]) + 1), lambda z: 0::BIGINT))) / (len(t[1]) + len(t[2])) AS score FROM p)
SELECT raw, round(score, 6)::DOUBLE AS score, shape_id, name FROM l WHERE score >= 82 QUALIFY row_number() OVER (PARTITION BY raw ORDER BY score DESC, shape_id) = 1"""


@query("match_fuzzy", FUZZY_SQL)
def match_fuzzy(load, spark):
    """Names with a letter too many, with their words turned round, and too short ones, against the index."""
    nations = load("nation").join(load("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    units = nations.select(F.col("n_nationkey").alias("shape_id"), F.concat("n_name", F.lit(" "), "r_name").alias("name"))
    longer = units.select(F.concat(F.substring("name", 1, 5), F.lit("x"), F.expr("substring(name, 6)")).alias("raw"))
    turned = nations.select(F.concat("r_name", F.lit(" "), "n_name", F.lit("Y")).alias("raw"))
    names = longer.union(turned).union(units.select(F.substring("name", 1, 3)))
    return mt.fuzzy_names(names, mt.name_index(units, VIETNAM), VIETNAM).withColumn("score", F.round("score", 6))


@query("parent_link", """SELECT 'n_regionkey' AS "column", 0.0::DOUBLE AS share, false AS linked, false AS sure UNION ALL SELECT 'r_name', 1.0::DOUBLE, true, true UNION ALL SELECT 'n_name', 0.0::DOUBLE, false, false""")
def parent_link(load, spark):
    fine = load("nation").join(load("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return mt.parent_links(load("region"), "r_name", fine, ["n_regionkey", "r_name", "n_name"], VIETNAM)


def _shares(load):
    keys = lambda df, c: df.select(normalize(F.col(c), VIETNAM).alias("key")).distinct()
    rows = load("customer").join(load("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(load("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.withColumn("c_mktsegment", F.upper("c_mktsegment"))
    return mt.place_columns(rows, ["n_name", "r_name", "c_mktsegment"], keys(load("region"), "r_name"), keys(load("nation"), "n_name"), VIETNAM)


@query("place_columns", """SELECT 'n_name' AS "column", 0.0::DOUBLE AS province_share, 1.0::DOUBLE AS commune_share, (SELECT count(DISTINCT c_nationkey) FROM customer) AS distinct_values
UNION ALL SELECT 'r_name', 1.0::DOUBLE, 0.0::DOUBLE, (SELECT count(DISTINCT n_regionkey) FROM nation JOIN customer ON c_nationkey = n_nationkey) UNION ALL SELECT 'c_mktsegment', 0.0::DOUBLE, 0.0::DOUBLE, (SELECT count(DISTINCT c_mktsegment) FROM customer)""")  # fmt: skip
def place_columns(load, spark):
    return _shares(load)


@query("admin_level", "SELECT 'commune' AS admin_level")
def admin_level(load, spark):
    return mt.admin_level(_shares(load))


SCORED = {"p_name": "p_name", "brand": "p_brand", "code": "'P-' || CAST(p_partkey AS {t})", "digits": "CAST(p_partkey AS {t})", "spaced": "'Xứ ' || p_name", "prose": "repeat(p_name || ' ', 9)"}
SHAPE = mt.CODE_SHAPE


@query("name_column_score", f"""WITH x AS ({" UNION ALL ".join(f"SELECT '{c}' AS column_name, trim({e.format(t='VARCHAR')}) AS v FROM part" for c, e in SCORED.items())}),
s AS (SELECT column_name, list_sort(list(length(v)))[count(*) // 2 + 1] AS median, count(DISTINCT v) / count(*) AS variety,
  (count(*) FILTER (regexp_matches(v, '[\\p{{L}}]')) - count(*) FILTER (regexp_matches(v, '{SHAPE}')) - count(*) FILTER (v = 'NA') + 0.15 * count(*) FILTER (contains(v, ' '))) / count(*) AS raw FROM x GROUP BY column_name)
SELECT column_name AS "column", round(CASE WHEN variety < 0.5 OR median < 2 OR median > 60 THEN 0 ELSE least(1, greatest(0, raw + CASE WHEN median BETWEEN 5 AND 30 THEN 0.15 WHEN median < 5 THEN -0.45 ELSE -0.25 END)) END, 6)::DOUBLE AS score FROM s""")  # fmt: skip
def name_column_score(load, spark):
    named = load("part").select(*(F.expr(e.format(t="STRING")).alias(c) for c, e in SCORED.items()))
    return mt.name_column_scores(named, list(SCORED)).withColumn("score", F.round("score", 6))


@query("coverage_left_join", """SELECT n_nationkey AS shape_id, round(v, 2) AS value FROM (SELECT n_nationkey FROM nation UNION ALL SELECT 100 + r_regionkey FROM region) LEFT JOIN (SELECT c_nationkey, sum(c_acctbal) AS v FROM customer GROUP BY 1) ON c_nationkey = n_nationkey""")
def coverage_left_join(load, spark):
    values = load("customer").groupBy(F.col("c_nationkey").alias("shape_id")).agg(F.round(F.sum("c_acctbal"), 2).alias("value"))
    units = load("nation").select(F.col("n_nationkey").alias("shape_id")).union(load("region").select(F.col("r_regionkey") + 100))
    return units.join(values, "shape_id", "left")


@query("scope_matched_only", "SELECT n_nationkey AS shape_id, n_name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def scope_matched_only(load, spark):
    return load("nation").join(load("supplier").where("s_acctbal > 5000"), F.col("n_nationkey") == F.col("s_nationkey"), "left_semi").select(F.col("n_nationkey").alias("shape_id"), "n_name")


@query("scope_province_series", "SELECT r_name, count(*) AS units, count(v) AS with_data FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT s_nationkey, sum(s_acctbal) AS v FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey GROUP BY r_name")
def scope_province_series(load, spark):
    values = load("supplier").groupBy("s_nationkey").agg(F.sum("s_acctbal").alias("v"))
    units = load("nation").join(load("region"), F.col("n_regionkey") == F.col("r_regionkey")).join(values, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return units.groupBy("r_name").agg(F.count("*").alias("units"), F.count("v").alias("with_data"))


SCOPED = "m AS (SELECT s_nationkey AS shape_id, CASE WHEN s_nationkey % 7 > 0 THEN r_name END AS province FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND s_acctbal > 0 LEFT JOIN region ON r_regionkey = n_regionkey), n AS (SELECT count(DISTINCT province) AS n, min(province) AS one FROM m)"


def scoped(load, **how):
    nation = load("nation").join(load("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    units = nation.select(F.col("n_nationkey").alias("shape_id"), F.col("r_name").alias("province"))
    names = units.withColumnRenamed("shape_id", "key")
    rows = load("supplier").withColumn("key", F.when(F.col("s_acctbal") > 0, F.col("s_nationkey"))).join(names, "key", "left")
    scope, maps = contexts(units, rows.select(F.col("s_nationkey").alias("shape_id"), F.when(F.col("s_nationkey") % 7 > 0, F.col("province")).alias("province")), **how)
    return maps.groupBy("map_name", "locator").agg(F.count("*").alias("units"), F.sum("shape_id").alias("ids")).withColumn("scope", F.lit(scope))


@query("scope_auto", f"""WITH {SCOPED} SELECT CASE WHEN n.n = 1 THEN 'single-province' WHEN n.n BETWEEN 2 AND 5 THEN 'province-series' ELSE 'national' END AS scope, CASE WHEN n.n BETWEEN 1 AND 5 THEN r_name ELSE 'national' END AS map_name, CASE WHEN n.n BETWEEN 1 AND 5 THEN r_name END AS locator, count(*) AS units, sum(n_nationkey)::BIGINT AS ids
FROM nation JOIN region ON n_regionkey = r_regionkey, n WHERE n.n NOT BETWEEN 1 AND 5 OR r_name IN (SELECT province FROM m WHERE province IS NOT NULL) GROUP BY ALL""")  # fmt: skip
def scope_auto(load, spark):
    """Few provinces have rows: a map for each of them."""
    return scoped(load)


@query("scope_auto_national", "SELECT 'national' AS scope, 'national' AS map_name, NULL::VARCHAR AS locator, count(*) AS units, sum(n_nationkey)::BIGINT AS ids FROM nation")
def scope_auto_national(load, spark):
    """More provinces than a series takes: one map."""
    return scoped(load, series_up_to=1)


@query("scope_units_with_data", f"""WITH {SCOPED} SELECT 'matched-only' AS scope, 'units with data' AS map_name, CASE WHEN n.n = 1 THEN n.one END AS locator, count(*) AS units, sum(n_nationkey)::BIGINT AS ids FROM nation, n WHERE n_nationkey IN (SELECT shape_id FROM m) GROUP BY ALL""")
def scope_units_with_data(load, spark):
    return scoped(load, scope="matched-only")
