"""Semantics, units and denominators: line items under headings as reports write them."""

from pyspark.sql import functions as F

from ..functions import headings as hd
from ..operators import semantics as sem
from .registry import query
from .text import D

#: heading: (SQL expression on lineitem, is a number)
COLUMNS = {
    "Số ca mắc": ("l_linenumber", True),
    "Số xét nghiệm": ("l_quantity", True),
    "Dân số mục tiêu": ("l_partkey", True),
    "Tỷ lệ dương tính (%)": ("CASE WHEN l_orderkey % 5 > 0 THEN l_linenumber / l_quantity * 100 END", True),
    "Độ bao phủ": ("l_discount", True),
    "Tỷ suất /100.000 dân": ("l_tax", True),
    "Chênh lệch (điểm %)": ("l_tax - 0.04", True),
    "Ngân sách (VND)": ("l_extendedprice", True),
    "Điểm số": ("l_tax * 10 + 0.5", True),
    "Năm": ("year(l_shipdate)", True),
    "Nam": ("l_partkey % 7", True),
    "Ca trong ngày": ("l_suppkey % 40", True),
    "Kinh độ": ("l_discount * 1000", True),
    "Vĩ độ": ("l_quantity - 25.5", True),
    "Đo được": ("l_discount - 0.05", True),
    "Mã ĐV": ("CAST(l_suppkey AS {t})", False),
    "Kỳ báo cáo": ("CAST(year(l_shipdate) AS {t})", False),
    "Nhóm": ("CASE WHEN l_orderkey % 9 > 0 THEN l_returnflag END", False),
    "Ghi chú": ("CAST(l_orderkey AS {t})", False),
}


def report(load):
    return load("lineitem").select(*(F.expr(e.format(t="STRING")).alias(h) for h, (e, _) in COLUMNS.items()))


def _facts_sql() -> str:
    parts = []
    for h, (e, number) in COLUMNS.items():
        x = e.format(t="VARCHAR")
        v = f"({x})::DOUBLE" if number else "NULL::DOUBLE"
        parts.append(
            f"SELECT '{h}' AS column_name, {number} AS is_numeric, count(*) AS n_rows, count(x) AS present, count(DISTINCT x) AS distinct_values, min(v) AS lo, max(v) AS hi, sum(v) AS total, "
            f"coalesce(bool_and(abs(v - round(v)) < 1e-9), false) AS integer_like, list_sort(list(v) FILTER (v IS NOT NULL))[count(v) // 2 + 1] AS upper_median FROM (SELECT {x} AS x, {v} AS v FROM lineitem)"
        )
    return "(" + " UNION ALL ".join(parts) + ")"


FACTS = _facts_sql()


@query("column_facts", f"SELECT column_name AS \"column\", is_numeric, n_rows, present, distinct_values, round(lo, 4) AS lo, round(hi, 4) AS hi, round(total / n_rows, 4) AS mean_total, integer_like, round(upper_median, 4) AS upper_median FROM {FACTS}")
def column_facts(load, spark):
    out = sem.column_facts(report(load)).withColumn("mean_total", F.col("total") / F.col("n_rows"))
    rounded = [F.round(c, 4).alias(c) if c in ("lo", "hi", "mean_total", "upper_median") else F.col(c) for c in ("column", "is_numeric", "n_rows", "present", "distinct_values", "lo", "hi", "mean_total", "integer_like", "upper_median")]
    return out.select(*rounded)


def says(words: list[str]) -> str:
    return f"regexp_matches(p, '{hd.any_of(words)}')"


def naming_sql(meaning: str) -> str:
    """The first word of a meaning that a heading holds."""
    plain = [w for w, of, accented, *_ in hd.NAMING if of == meaning and not accented]
    marked = [(w, accented) for w, of, accented, *_ in hd.NAMING if of == meaning and accented]
    told = " ".join(f"WHEN regexp_matches(w, '{hd.any_of([a])}') OR (p = w AND regexp_matches(w, '{hd.any_of([b])}')) THEN '{b}'" for b, a in marked)
    return f"CASE WHEN {says(plain)} THEN 'any' {told} END"


def semantic_sql(facts: str) -> str:
    time = naming_sql("time")
    period = " OR ".join(f"(word = '{w}' AND integer_like AND lo >= {a} AND hi <= {b})" for w, _, _, a, b in hd.NAMING if a)
    return f"""SELECT *, CASE WHEN NOT is_numeric THEN CASE WHEN word IS NOT NULL THEN 'time' WHEN {naming_sql('identifier')} IS NOT NULL THEN 'identifier'
  WHEN distinct_values > 0 AND distinct_values <= greatest(12, 0.15 * n_rows) THEN 'category' ELSE 'text' END
WHEN {says(hd.LON_WORDS)} AND greatest(abs(lo), abs(hi)) <= 180 THEN 'coordinate' WHEN {says(hd.LAT_WORDS)} AND greatest(abs(lo), abs(hi)) <= 90 THEN 'coordinate' WHEN {says(hd.POINT_WORDS)} THEN 'percentage-point'
WHEN {says(hd.RATE_WORDS)} OR regexp_matches(p, '{hd.PER_PEOPLE}') THEN 'rate-per-capita' WHEN {says(hd.MONEY_WORDS)} OR regexp_matches(p, '{hd.MONEY_UNIT}') THEN 'money' WHEN {says(hd.PERCENT_WORDS)} OR contains(column_name, '%') THEN 'percent'
WHEN {says(hd.SCORE_WORDS)} THEN 'score' WHEN NOT counts AND (word = 'any' OR {period}) THEN 'time' WHEN counts OR (integer_like AND lo >= 0) THEN 'count' ELSE 'unknown' END AS semantic
FROM (SELECT *, {time} AS word, {says(hd.COUNT_WORDS)} AS counts FROM (SELECT *, trim({D.format('column_name')}) AS p, lower(column_name) AS w FROM {facts}))"""


SEMANTICS = f"({semantic_sql(FACTS)})"


@query("infer_semantics", f"""SELECT column_name AS "column", semantic, CASE WHEN semantic = 'percent' THEN CASE WHEN hi <= 1.5 THEN 'unit' ELSE 'percent' END END AS scale,
CASE semantic WHEN 'percent' THEN CASE WHEN hi <= 1.5 THEN 1.0 ELSE 100.0 END WHEN 'rate-per-capita' THEN replace(regexp_extract(column_name, '/\\s*([0-9.,]+)', 1), '.', '')::DOUBLE ELSE 100.0 END::DOUBLE AS multiplier,
CASE semantic WHEN 'count' THEN 'sum' WHEN 'money' THEN 'sum' WHEN 'percent' THEN 'weighted-mean' WHEN 'percentage-point' THEN 'weighted-mean' WHEN 'rate-per-capita' THEN 'recompute' WHEN 'category' THEN 'mode' ELSE 'mean' END AS default_method,
semantic NOT IN ('percent', 'rate-per-capita', 'percentage-point', 'score') AS safe_to_sum, semantic NOT IN ('time', 'identifier', 'text', 'coordinate') AS mappable FROM {SEMANTICS}""")  # fmt: skip
def infer_semantics(load, spark):
    return sem.with_semantics(sem.column_facts(report(load))).select("column", "semantic", "scale", "multiplier", "default_method", "safe_to_sum", "mappable")


PAIRS = ["Số ca mắc", "Số xét nghiệm", "Dân số mục tiêu", "Tỷ lệ dương tính (%)", "Độ bao phủ", "Ca trong ngày"]


def _fit_sql() -> str:
    """Every ordered pair of counts against each rate."""
    value = lambda h: f"({COLUMNS[h][0]})::DOUBLE"
    counts, rates = ["Số ca mắc", "Số xét nghiệm", "Dân số mục tiêu", "Ca trong ngày"], {"Tỷ lệ dương tính (%)": 100.0, "Độ bao phủ": 1.0}
    parts = [
        f"SELECT '{r}' AS rate, '{n}' AS numerator, '{d}' AS denominator, avg(abs({value(n)} / {value(d)} * {s} - {value(r)}) / {value(r)}) FILTER ({value(r)} > 0 AND {value(d)} > 0) AS error, count(*) FILTER ({value(r)} > 0 AND {value(d)} > 0) AS n, count(*) AS total FROM lineitem"
        for r, s in rates.items() for n in counts for d in counts if n != d
    ]
    return f"SELECT rate, numerator, denominator, round(error, 6) AS error FROM ({' UNION ALL '.join(parts)}) WHERE error <= 0.02 AND n >= greatest(3, total * 0.5) QUALIFY row_number() OVER (PARTITION BY rate ORDER BY error, denominator, numerator) = 1"


@query("fit_denominator", _fit_sql())
def fit_denominator(load, spark):
    df = report(load).select(*PAIRS)
    return sem.fitted_denominators(df, sem.with_semantics(sem.column_facts(df))).withColumn("error", F.round("error", 6))


STOP = ", ".join(f"'{w}'" for w in hd.STOPWORDS)


def tokens_sql(c: str) -> str:
    words = f"regexp_split_to_array(trim({D.format(c)}), '[^\\p{{L}}\\p{{N}}_]+')"
    return f"list_distinct(list_filter({words}, lambda w: w <> '' AND NOT regexp_full_match(w, '[0-9]+') AND w NOT IN ({STOP})))"


@query("denominator_by_name", f"""WITH s AS (SELECT column_name, semantic, coalesce(total, hi, upper_median, 0) AS size, {tokens_sql('column_name')} AS ts, trim({D.format('column_name')}) AS pl FROM {SEMANTICS}),
p AS (SELECT r.column_name AS rate, c.column_name AS denominator, c.size, len(list_intersect(r.ts, c.ts)) AS overlap, contains(c.pl, 'dan so') AS people,
  {"coalesce(" + ", ".join(f"CASE WHEN contains(r.pl, '{t}') AND contains(c.pl, '{w}') THEN {k} END" for k, (t, w) in enumerate((t, w) for t, ws in sem.DENOMINATOR_HINTS.items() for w in ws)) + ")"} AS hint
  FROM s r, s c WHERE r.semantic IN ('percent', 'rate-per-capita', 'percentage-point', 'ratio') AND c.semantic = 'count')
SELECT rate, coalesce(a, b, c) AS denominator, CASE WHEN a IS NOT NULL THEN 'name' WHEN b IS NOT NULL THEN 'hint' WHEN c IS NOT NULL THEN 'population' ELSE 'none' END AS basis FROM (
SELECT rate, arg_min(denominator, (-overlap, -size, denominator)) FILTER (overlap > 0) AS a, arg_min(denominator, (hint, denominator)) FILTER (hint IS NOT NULL) AS b, min(denominator) FILTER (people) AS c FROM p GROUP BY rate)""")  # fmt: skip
def denominator_by_name(load, spark):
    return sem.named_denominators(sem.with_semantics(sem.column_facts(report(load))))


HEADED = "CASE p_partkey % 6 WHEN 0 THEN 'Tỷ suất /100.000 dân' WHEN 1 THEN 'Ca mới 2025' WHEN 2 THEN 'Kinh phí (USD)' WHEN 3 THEN 'Chi phí (đồng)' WHEN 4 THEN 'Tỷ suất mắc / 1.000 dân ' || p_brand ELSE 'Ngân sách ' || p_type END"


@query("heading_units", f"""SELECT p_partkey, array_to_string(list_sort({tokens_sql('h')}), ' ') AS tokens, regexp_extract(h, '/\\s*([0-9.,]+)', 1) AS per,
CASE WHEN contains(p, 'vnd') THEN 'VND' WHEN contains(p, 'usd') THEN 'USD' WHEN contains(p, 'dong') THEN 'đồng' ELSE 'tiền' END AS money FROM (SELECT *, trim({D.format('h')}) AS p FROM (SELECT p_partkey, {HEADED} AS h FROM part))""")
def heading_units(load, spark):
    h = F.col("h")
    return load("part").select("p_partkey", F.expr(HEADED).alias("h")).select("p_partkey", F.array_join(F.array_sort(hd.name_tokens(h)), " ").alias("tokens"), hd.rate_unit(h).alias("per"), hd.money_unit(h).alias("money"))


UNITED = "CASE p_partkey % 4 WHEN 0 THEN 'Tỷ suất ca mới' WHEN 1 THEN 'Tỷ suất ca mới/100.000 dân' WHEN 2 THEN 'Tỷ suất /1.000 người' ELSE 'Coverage' END"


@query("heading_with_unit", f"SELECT p_partkey, h || CASE p_partkey % 4 WHEN 0 THEN ' (trên 100.000 dân)' WHEN 2 THEN ' (trên 100.000 dân)' ELSE '' END AS heading FROM (SELECT p_partkey, {UNITED} AS h FROM part)")
def heading_with_unit(load, spark):
    semantic = F.when(F.col("p_partkey") % 4 == 3, "percent").otherwise("rate-per-capita")
    return load("part").select("p_partkey", hd.heading_with_unit(F.expr(UNITED), semantic, F.lit("trên 100.000 dân")).alias("heading"))
