"""Text, numbers as written, periods."""

from pyspark.sql import functions as F

from ..functions import numbers as num
from ..functions import periods as per
from ..functions import text as tx
from .registry import query

D = "replace(strip_accents(lower({})), 'đ', 'd')"
PLAIN = r"trim(regexp_replace(regexp_replace({}, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def plain_sql(c: str) -> str:
    return PLAIN.format(D.format(c))


def normalize_sql(c: str, affixes: str = tx.VIETNAM) -> str:
    return f"trim(regexp_replace({plain_sql(c)}, '{affixes}', '', 'g'))"


@query("text_deaccent", f"SELECT doc_id, {D.format('text')} AS plain FROM documents")
def text_deaccent(load, spark):
    return load("documents").select("doc_id", tx.deaccent(F.col("text")).alias("plain"))


@query("text_normalize_plain", f"SELECT doc_id, {plain_sql('text')} AS plain FROM documents")
def text_normalize_plain(load, spark):
    return load("documents").select("doc_id", tx.normalize_plain(F.col("text")).alias("plain"))


NAMES = "CASE p_partkey % 5 WHEN 0 THEN 'Thành phố ' || p_name WHEN 1 THEN p_name || ' Province' WHEN 2 THEN 'Tỉnh của-' || p_name WHEN 3 THEN 'Quận de ' || upper(p_name) ELSE 'Đ. ' || p_name END"


@query("text_normalize", f"SELECT p_partkey, {normalize_sql(NAMES)} AS key FROM part")
def text_normalize(load, spark):
    return load("part").select("p_partkey", tx.normalize(F.expr(NAMES), tx.VIETNAM).alias("key"))


@query("text_slugify", f"""SELECT p_partkey, regexp_replace(substr(regexp_replace(regexp_replace({D.format(NAMES)}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 70), '-+$', '') AS slug FROM part""")
def text_slugify(load, spark):
    return load("part").select("p_partkey", tx.slugify(F.expr(NAMES)).alias("slug"))


BLANKS = "CASE l_orderkey % 7 WHEN 0 THEN ' - ' WHEN 1 THEN 'N/A' WHEN 2 THEN 'không có' WHEN 3 THEN '' WHEN 4 THEN NULL WHEN 5 THEN ' 	..	' ELSE l_returnflag END"
BLANK_LIST = ", ".join(f"'{w}'" for w in tx.BLANK_WORDS)


@query("text_is_blank", f"SELECT l_orderkey, l_linenumber, ({BLANKS}) IS NULL OR lower(trim({BLANKS}, ' ' || chr(9))) IN ({BLANK_LIST}) AS blank FROM lineitem")
def text_is_blank(load, spark):
    return load("lineitem").select("l_orderkey", "l_linenumber", tx.is_blank(F.expr(BLANKS)).alias("blank"))


@query("text_label_of", f"SELECT l_orderkey, l_linenumber, CASE WHEN lower(trim(coalesce({BLANKS}, ''), ' ' || chr(9))) IN ('', 'nan', 'none', 'nat', 'null', '<na>') THEN '' ELSE trim({BLANKS}, ' ' || chr(9)) END AS label FROM lineitem")
def text_label_of(load, spark):
    return load("lineitem").select("l_orderkey", "l_linenumber", tx.label_of(F.expr(BLANKS)).alias("label"))


CENTS = "CAST(floor(l_extendedprice) AS BIGINT)"
WRITTEN = f"""CASE l_linenumber % 7 WHEN 0 THEN CAST({CENTS} % 1000 AS VARCHAR(20)) || ',5' WHEN 1 THEN CAST({CENTS} // 1000 AS VARCHAR(20)) || '.' || lpad(CAST({CENTS} % 1000 AS VARCHAR(20)), 3, '0')
WHEN 2 THEN CAST({CENTS} // 1000 AS VARCHAR(20)) || ',' || lpad(CAST({CENTS} % 1000 AS VARCHAR(20)), 3, '0') || '.25' WHEN 3 THEN ' ' || CAST({CENTS} AS VARCHAR(20)) || ' %' WHEN 4 THEN '-' WHEN 5 THEN '1.2.3' ELSE CAST({CENTS} AS VARCHAR(20)) END"""
WRITTEN_SPARK = WRITTEN.replace(f"{CENTS} // 1000", f"({CENTS} div 1000)").replace("VARCHAR(20)", "STRING")


def parse_sql(c: str) -> str:
    t = f"regexp_replace(regexp_replace(trim({c}), '[  ]', '', 'g'), '%+$', '')"
    plain = (
        rf"CASE WHEN regexp_full_match({t}, '-?\d{{1,3}}(\.\d{{3}})+(,\d+)?') THEN replace(replace({t}, '.', ''), ',', '.') "
        rf"WHEN regexp_full_match({t}, '-?\d{{1,3}}(,\d{{3}})+(\.\d+)?') THEN replace({t}, ',', '') WHEN regexp_full_match({t}, '-?\d+,\d+') THEN replace({t}, ',', '.') ELSE {t} END"
    )
    return rf"CASE WHEN NOT (lower(trim({c})) IN ({BLANK_LIST})) AND regexp_full_match({plain}, '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?') THEN try_cast({plain} AS DOUBLE) END"


@query("text_parse_number", f"SELECT l_orderkey, l_linenumber, {parse_sql('x')} AS number FROM (SELECT *, {WRITTEN} AS x FROM lineitem)")
def text_parse_number(load, spark):
    return load("lineitem").select("l_orderkey", "l_linenumber", tx.parse_number(F.expr(WRITTEN_SPARK)).alias("number"))


@query("text_coerce_share", f"""SELECT l_returnflag, count(*) FILTER (NOT b) AS present, count(*) FILTER (number IS NOT NULL) AS readable, count(*) FILTER (number IS NOT NULL) >= 0.9 * count(*) FILTER (NOT b) AS coerce
FROM (SELECT *, {parse_sql('x')} AS number, x IS NULL OR lower(trim(x)) IN ({BLANK_LIST}) AS b FROM (SELECT *, {WRITTEN} AS x FROM lineitem)) GROUP BY l_returnflag""")  # fmt: skip
def text_coerce_share(load, spark):
    rows = load("lineitem").select("l_returnflag", F.expr(WRITTEN_SPARK).alias("x"))
    present, readable = F.count_if(~tx.is_blank(F.col("x"))), F.count_if(tx.parse_number(F.col("x")).isNotNull())
    return rows.groupBy("l_returnflag").agg(present.alias("present"), readable.alias("readable"), (readable >= 0.9 * present).alias("coerce"))


@query("text_total_like", "SELECT o_orderkey, lower(trim(x)) IN ('total', '(total)', 'all', '(all)', 'tổng') AS is_total FROM (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'Total' WHEN 1 THEN '(ALL)' WHEN 2 THEN 'Tổng' WHEN 3 THEN '(total)' ELSE o_orderstatus END AS x FROM orders)")
def text_total_like(load, spark):
    x = F.expr("CASE o_orderkey % 5 WHEN 0 THEN 'Total' WHEN 1 THEN '(ALL)' WHEN 2 THEN 'Tổng' WHEN 3 THEN '(total)' ELSE o_orderstatus END")
    return load("orders").select("o_orderkey", tx.is_total_like(x).alias("is_total"))


@query("text_demojibake", "SELECT n_nationkey, 'Đà Nẵng ' || n_name AS fixed FROM nation")
def text_demojibake(load, spark):
    broken = F.decode(F.encode(F.concat(F.lit("Đà Nẵng "), F.col("n_name")), "UTF-8"), "ISO-8859-1")
    return load("nation").select("n_nationkey", tx.demojibake(broken).alias("fixed"))


@query("format_values", """SELECT n_nationkey, replace(format('{:,}', (n_nationkey * 1234567)::BIGINT), ',', '.') AS cases, (n_nationkey * 3) || '%' AS share FROM nation""")
def format_values(load, spark):
    return load("nation").select("n_nationkey", num.format_value(F.col("n_nationkey") * 1234567, "count").alias("cases"), num.format_value(F.col("n_nationkey") * 3, "percent", 0).alias("share"))


PERIODS = """CASE o_orderkey % 8 WHEN 0 THEN '{day}' WHEN 1 THEN 'Quý ' || CASE quarter(o_orderdate) WHEN 1 THEN 'I' WHEN 2 THEN 'II' WHEN 3 THEN 'III' ELSE 'IV' END || '/' || year(o_orderdate)
WHEN 2 THEN 'T' || month(o_orderdate) || '/' || year(o_orderdate) WHEN 3 THEN '{month}' WHEN 4 THEN lpad(CAST(month(o_orderdate) AS {text}), 2, '0') || '/' || year(o_orderdate) WHEN 5 THEN 'Năm ' || year(o_orderdate)
WHEN 6 THEN 'Q' || quarter(o_orderdate) || ' ' || year(o_orderdate) ELSE 'chưa rõ' END"""
PERIODS_SPARK = PERIODS.replace("'{day}'", "date_format(o_orderdate, 'yyyy-MM-dd')").replace("'{month}'", "date_format(o_orderdate, 'yyyy-MM')").replace("{text}", "STRING")
PERIODS_SQL = PERIODS.replace("'{day}'", "strftime(o_orderdate, '%Y-%m-%d')").replace("'{month}'", "strftime(o_orderdate, '%Y-%m')").replace("{text}", "VARCHAR")
#: What each text says, from the date it was made of.
TRUTH = """CASE WHEN o_orderkey % 8 = 7 THEN NULL ELSE year(o_orderdate)::INT END AS y,
CASE o_orderkey % 8 WHEN 7 THEN NULL WHEN 5 THEN 1 WHEN 1 THEN (quarter(o_orderdate) * 3 - 2)::INT WHEN 6 THEN (quarter(o_orderdate) * 3 - 2)::INT ELSE month(o_orderdate)::INT END AS m,
CASE o_orderkey % 8 WHEN 7 THEN NULL WHEN 0 THEN day(o_orderdate)::INT ELSE 1 END AS d,
CASE o_orderkey % 8 WHEN 0 THEN 'day' WHEN 1 THEN 'quarter' WHEN 6 THEN 'quarter' WHEN 5 THEN 'year' WHEN 7 THEN NULL ELSE 'month' END AS granularity"""


def _periods(load):
    return load("orders").withColumn("period", F.expr(PERIODS_SPARK))


@query("period_parse", f"SELECT o_orderkey, {TRUTH} FROM orders")
def period_parse(load, spark):
    return _periods(load).select("o_orderkey", per.parse_period(F.col("period")).alias("p")).select("o_orderkey", "p.*")


@query("period_order", f"""WITH p AS (SELECT DISTINCT period, y, m, d FROM (SELECT {PERIODS_SQL} AS period, {TRUTH} FROM orders))
SELECT period, (row_number() OVER (ORDER BY coalesce(y, 9999), coalesce(m, 99), coalesce(d, 99), period) - 1)::INT AS ord FROM p""")  # fmt: skip
def period_order(load, spark):
    return per.ordered_periods(_periods(load), "period")


@query("period_granularity", "SELECT 'day' AS granularity, 1::BIGINT AS unreadable")
def period_granularity(load, spark):
    return per.granularity(_periods(load), "period")


@query("period_latest", """WITH p AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS period, count(DISTINCT user_id) AS places, sum(value) AS total FROM events GROUP BY ALL)
SELECT event_type, period, places, round(total, 4) AS total FROM p QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY period DESC) = 1""")  # fmt: skip
def period_latest(load, spark):
    e = load("events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return per.latest_period(e, ["event_type"], "day", "user_id", "value").withColumn("total", F.round("total", 4))
