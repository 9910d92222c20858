"""Workbooks as long cell grids, parsed from their XML in tasks: one file is one row of work."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import stage

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
CELLS = "path string, sheet string, row int, col int, value string, r1 int, c1 int"


def place(reference: str) -> tuple[int, int]:
    """(row, column) from zero of a reference such as ``BC12``."""
    letters, digits = re.fullmatch(r"([A-Z]+)([0-9]+)", reference).groups()
    col = 0
    for c in letters:
        col = 26 * col + ord(c) - 64
    return int(digits) - 1, col - 1


# The built-in number formats that show a date or a time.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
#: What of a format code is literal: quoted and escaped text, and what stands in brackets, colours and conditions.
LITERAL = re.compile(r'"[^"]*"|\\.|\[[^\]]*\]|_.|\*.')
EPOCHS = {False: datetime(1899, 12, 30), True: datetime(1904, 1, 1)}


def date_styles(styles: bytes) -> set[int]:
    """The cell styles that show a number as a date or time."""
    root = ElementTree.fromstring(styles)
    codes = {int(f.get("numFmtId")): LITERAL.sub("", f.get("formatCode", "")).lower() for f in root.iter(f"{MAIN}numFmt")}
    dated = lambda k: any(c in codes[k] for c in "ymdhs") and "general" not in codes[k] if k in codes else k in DATE_FORMATS
    formats = root.find(f"{MAIN}cellXfs")
    return {k for k, x in enumerate(formats if formats is not None else ()) if dated(int(x.get("numFmtId", 0)))}


def moment(serial: str, since_1904: bool) -> str:
    """A serial number as a date, a time of day below 1, or both."""
    n = float(serial)
    # The older count has a 29 February 1900 that never was.
    days = n + 1 if not since_1904 and 1 <= n < 60 else n
    at = EPOCHS[since_1904] + timedelta(seconds=round(days * 86400))
    if 0 <= n < 1:
        return at.strftime("%H:%M:%S")
    return at.strftime("%Y-%m-%d") if not (at.hour or at.minute or at.second) else at.strftime("%Y-%m-%d %H:%M:%S")


def cells_of(content: bytes) -> Iterator[tuple]:
    """(sheet, row, col, value, last row, last col) of each cell with a value, and of each merged range (value null). Numbers that are shown as
    dates come as dates, truth values as True and False, errors as nothing; a cell without a reference follows the one before."""
    book = zipfile.ZipFile(io.BytesIO(content))
    names = book.namelist()
    text = lambda node: "".join(t.text or "" for t in node.iter(f"{MAIN}t"))
    shared = [text(s) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")] if "xl/sharedStrings.xml" in names else []
    dated = date_styles(book.read("xl/styles.xml")) if "xl/styles.xml" in names else set()
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    since_1904 = any(p.get("date1904") in ("1", "true") for p in root.iter(f"{MAIN}workbookPr"))

    def value_of(c: ElementTree.Element) -> str | None:
        v, kind = c.find(f"{MAIN}v"), c.get("t", "n")
        if kind == "inlineStr":
            return text(c)
        if v is None or v.text is None or kind == "e":
            return None
        if kind == "s":
            return shared[int(v.text)]
        if kind == "b":
            return str(v.text.strip() == "1")
        return moment(v.text, since_1904) if kind == "n" and int(c.get("s", 0)) in dated else v.text

    for sheet in root.iter(f"{MAIN}sheet"):
        target = links[sheet.get(LINK)].lstrip("/")
        page = ElementTree.fromstring(book.read(target if target.startswith("xl/") else f"xl/{target}"))
        row = -1
        for r in page.iter(f"{MAIN}row"):
            row, col = int(r.get("r")) - 1 if r.get("r") else row + 1, -1
            for c in r.iter(f"{MAIN}c"):
                row, col = place(c.get("r")) if c.get("r") else (row, col + 1)
                value = value_of(c)
                if value not in (None, ""):
                    yield sheet.get("name"), row, col, value, row, col
        for m in page.iter(f"{MAIN}mergeCell"):
            ends = [place(x) for x in m.get("ref").split(":")]
            yield sheet.get("name"), *ends[0], None, *ends[-1]


def read_workbooks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cells, merges): ``(path, sheet, row, col, value)`` and ``(path, sheet, r0, c0, r1, c1)`` of all workbooks under a path, rows and
    columns from zero. A workbook is parsed once, in one task, so it must fit there, and its cells are staged; values are text, see
    `cells_of`."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, content in zip(f["path"], f["content"]):
                yield pd.DataFrame([(name, *c) for c in cells_of(content)], columns=["path", "sheet", "row", "col", "value", "r1", "c1"])

    all_cells = spark.read.format("binaryFile").option("pathGlobFilter", "*.xls[xm]").load(path).select("path", "content").mapInPandas(run, CELLS)
    all_cells = stage(all_cells, "cells")
    merges = all_cells.where("value is null").select("path", "sheet", F.col("row").alias("r0"), F.col("col").alias("c0"), "r1", "c1")
    return all_cells.where("value is not null").select("path", "sheet", "row", "col", "value"), merges
