"""Untidy sheets: cells made from ``nation``."""

from pyspark.sql import functions as F

from ..functions.text import normalize
from ..operators import grid as gr
from ..operators.survey import survey_files, survey_sheets
from .matching import VIETNAM
from .registry import query

# Title block, blank rows, two header tiers, data, blank rows, a second table.
CELLS = """(SELECT 0 AS row, 0 AS col, 'Báo cáo tháng' AS value UNION ALL SELECT 3, 0, 'Tỉnh' UNION ALL SELECT 3, 1, 'Số ca phát hiện' UNION ALL SELECT 4, 0, 'Tỉnh' UNION ALL SELECT 4, 1, 'Nam' UNION ALL SELECT 4, 2, 'Nữ'
UNION ALL SELECT 5 + n_nationkey, 0, n_name FROM nation UNION ALL SELECT 5 + n_nationkey, 1, CAST(n_nationkey * 10 AS {t}) FROM nation UNION ALL SELECT 5 + n_nationkey, 2, CAST(n_nationkey * 20 AS {t}) FROM nation
UNION ALL SELECT 40 + r_regionkey, 0, r_name FROM region UNION ALL SELECT 40 + r_regionkey, 1, CAST(r_regionkey AS {t}) FROM region)"""
CELLS_SQL, CELLS_SPARK = CELLS.format(t="VARCHAR"), CELLS.format(t="STRING")
MERGED = "(VALUES (3, 1, 3, 2), (5, 0, 9, 0)) AS t(r0, c0, r1, c1)"


def cells(load, spark):
    load("nation").createOrReplaceTempView("nation")
    load("region").createOrReplaceTempView("region")
    return spark.sql(f"SELECT * FROM {CELLS_SPARK}")


@query("grid_header_row", "SELECT 4::INT AS row, 3.0::DOUBLE AS score")
def grid_header_row(load, spark):
    return gr.header_row(cells(load, spark))


@query("grid_table_blocks", "SELECT 3 AS first_row, (SELECT 5 + max(n_nationkey) FROM nation)::INT AS last_row UNION ALL SELECT 40, (SELECT 40 + max(r_regionkey) FROM region)::INT")
def grid_table_blocks(load, spark):
    return gr.table_blocks(cells(load, spark))


@query("grid_fill_merged", f"""SELECT row::INT AS row, col::INT AS col, value FROM {CELLS_SQL} c WHERE NOT EXISTS (SELECT 1 FROM {MERGED} WHERE row BETWEEN r0 AND r1 AND col BETWEEN c0 AND c1)
UNION ALL SELECT r.x::INT, k.x::INT, h.value FROM {MERGED}, range(0, 60) r(x), range(0, 5) k(x), {CELLS_SQL} h WHERE r.x BETWEEN r0 AND r1 AND k.x BETWEEN c0 AND c1 AND h.row = r0 AND h.col = c0""")  # fmt: skip
def grid_fill_merged(load, spark):
    return gr.fill_merged(cells(load, spark), spark.sql(f"SELECT * FROM {MERGED}"))


@query("grid_join_header", "SELECT * FROM (VALUES (0, 'Tỉnh'), (1, 'Số ca phát hiện - Nam'), (2, 'Số ca phát hiện - Nữ')) t(col, name)")
def grid_join_header(load, spark):
    filled = gr.fill_merged(cells(load, spark), spark.sql(f"SELECT * FROM {MERGED}"))
    return gr.joined_header(filled, 3, 2)


@query("grid_as_table", "SELECT 5 + n_nationkey AS _row, n_name AS place, (n_nationkey * 10)::VARCHAR AS male, (n_nationkey * 20)::VARCHAR AS female FROM nation")
def grid_as_table(load, spark):
    grid = cells(load, spark)
    return gr.as_table(grid.where("row < 40"), ["place", "male", "female"], 5)


@query("sheet_usability", "SELECT count(*) AS n_rows, 'no-place-column' AS verdict FROM orders")
def sheet_usability(load, spark):
    return gr.usability(load("orders"), None)


# A workbook for each region: a sheet for each market segment with a row for each nation, one of codes, one of notes without a header.
SHEETS = """(SELECT r_name || '.xlsx' AS path, c_mktsegment AS sheet, n_name, count(*) AS n, (2 + row_number() OVER (PARTITION BY r_name, c_mktsegment ORDER BY n_name)) AS row
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, c_mktsegment, n_name)"""
CODES = "(SELECT r_name || '.xlsx' AS path, s_suppkey, row_number() OVER (PARTITION BY r_name ORDER BY s_suppkey) AS row FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
BOOKS = f"""SELECT path, sheet, CAST(row AS INT) AS row, CAST(col AS INT) AS col, value FROM (
SELECT DISTINCT path, sheet, 0 AS row, 0 AS col, 'Báo cáo' AS value FROM {SHEETS} s UNION ALL SELECT DISTINCT path, sheet, 2, 0, 'Quốc gia' FROM {SHEETS} s UNION ALL SELECT DISTINCT path, sheet, 2, 1, 'Số khách' FROM {SHEETS} s
UNION ALL SELECT path, sheet, row, 0, n_name FROM {SHEETS} s UNION ALL SELECT path, sheet, row, 1, CAST(n AS STRING) FROM {SHEETS} s
UNION ALL SELECT DISTINCT path, 'codes', 0, col, value FROM {CODES} c, (VALUES (0, 'Mã'), (1, 'Tên mã')) AS h(col, value) UNION ALL SELECT path, 'codes', row, 0, CAST(s_suppkey AS STRING) FROM {CODES} c UNION ALL SELECT path, 'codes', row, 1, CONCAT('x', CAST(s_suppkey AS STRING)) FROM {CODES} c
UNION ALL SELECT DISTINCT path, 'blank', 5, 3, ' ' FROM {CODES} c)"""


def surveyed(load, spark):
    for t in ("customer", "nation", "region", "supplier"):
        load(t).createOrReplaceTempView(t)
    names = load("nation").select(normalize(F.col("n_name"), VIETNAM).alias("key"))
    return survey_sheets(spark.sql(BOOKS), names, None, VIETNAM)


SURVEYED = f"""(SELECT path, sheet, 'ok' AS verdict, 2 AS header_row, 2 AS n_columns, count(*) AS n_rows, 1 AS n_tables, 'Quốc gia' AS province_column, 'province' AS level FROM {SHEETS} s GROUP BY path, sheet
UNION ALL SELECT path, 'codes', 'no-place-column', 0, 2, count(*), 1, NULL, NULL FROM {CODES} c GROUP BY path UNION ALL SELECT DISTINCT path, 'blank', 'sheet-empty', NULL, 4, 0, 0, NULL, NULL FROM {CODES} c)"""


@query("survey_sheets", f"SELECT * FROM {SURVEYED}")
def survey_sheets_query(load, spark):
    return surveyed(load, spark).drop("commune_column")


@query("survey_files", f"SELECT path, count(*) AS sheets, count(*) FILTER (verdict = 'ok') AS usable, array_to_string(list_sort(list(sheet) FILTER (verdict = 'ok')), ',') AS preferred FROM {SURVEYED} GROUP BY path")
def survey_files_query(load, spark):
    return survey_files(surveyed(load, spark)).withColumn("preferred", F.array_join("preferred", ","))
