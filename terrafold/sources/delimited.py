"""Delimited text: what it is written in, all columns as text, numbers where nearly all cells are numbers."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_blank, parse_number, strip
from .lines import RANGE_BYTES, read_ranges, steps

SUFFIXES = ["csv", "tsv", "txt", "xlsx", "xlsm", "xls"]
PEEKED, SAMPLED = 64_000, 20
#: Encodings in the order they are tried, with Spark's names.
ENCODINGS = {"utf-8-sig": "UTF-8", "cp1258": "windows-1258", "latin-1": "ISO-8859-1"}
#: Part of the filled cells that must read as numbers for a column to become one.
NUMERIC = 0.9


def list_tables(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, length)`` of the tables in a folder, in order; contents are not read."""
    files = spark.read.format("binaryFile").load(folder).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(F.lower(name).rlike(rf"\.({'|'.join(SUFFIXES)})$") & ~name.startswith("~$")).orderBy("path")


def text_dialect(head: bytes) -> tuple[str, str]:
    """(encoding, separator) of the first bytes of a file: the first encoding that reads them; the separator that a sniffer finds in a
    few lines, else the commonest of tab, semicolon, comma and bar, else a comma."""
    head, text = head[:PEEKED], ""
    for name, encoding in ENCODINGS.items():
        try:
            text = head.decode(name)
        except UnicodeDecodeError as e:
            if not (name == "utf-8-sig" and len(head) == PEEKED and e.start > len(head) - 4):  # else only the last character was cut
                continue
            text = head[: e.start].decode(name)
        break
    lines = "\n".join(text.splitlines()[:SAMPLED])
    try:
        return encoding, csv.Sniffer().sniff(lines, delimiters=",;\t|").delimiter
    except csv.Error:
        found = {c: lines.count(c) for c in "\t;,|"}
        return encoding, max(found, key=found.get) if any(found.values()) else ","


def headings_of(head: bytes) -> tuple[str, str, list[str]]:
    """(encoding, separator, headings) of the first bytes of a file: headings stripped, blank ones named by their place, repeats numbered."""
    encoding, separator = text_dialect(head)
    first = next(csv.reader(io.StringIO(head[:PEEKED].decode(encoding, "replace").lstrip("\ufeff"), newline=""), delimiter=separator), [])
    names: list[str] = []
    for k, cell in enumerate(first):
        name = base = cell.strip() or f"Unnamed: {k}"
        n = 0
        while name in names:
            n += 1
            name = f"{base}.{n}"
        names.append(name)
    return encoding, separator, names


def read_delimited(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Every column as text, only empty cells null. Each file has its own dialect and headings, told by its first bytes; columns of several
    files meet by name, in the order in which they first occur, null where a file has none.

    Files are listed without their contents, a task reads the first PEEKED bytes of each, and `read_ranges` splits large ones, quoted
    line ends or not. What the driver holds is a heading for each file. No file: ValueError.
    """
    files = [(r.path, r.length) for r in spark.read.format("binaryFile").load(path).select("path", "length").orderBy("path").collect()]
    if not files:
        raise ValueError(f"no file at {path}")
    asked = spark.createDataFrame([(k, p, n) for k, (p, n) in enumerate(files)], "k int, path string, size long").repartition(min(len(files), 4 * spark.sparkContext.defaultParallelism), "k")

    def peek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told = [headings_of(b"".join(steps(r["path"], 0, min(r["size"], PEEKED)))) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t[0] for t in told]), pa.array([t[1] for t in told]), pa.array([t[2] for t in told], pa.list_(pa.string()))], ["k", "encoding", "separator", "names"])

    alike: dict[tuple, list[tuple[str, int]]] = {}
    for r in asked.mapInArrow(peek, "k int, encoding string, separator string, names array<string>").orderBy("k").collect():
        if r.names:
            alike.setdefault((r.encoding, r.separator, tuple(r.names)), []).append(files[r.k])
    if not alike:
        return spark.createDataFrame([], "`Unnamed: 0` string")
    kinds = [read_ranges(spark, some, len(names), separator, encoding, range_bytes).toDF(*names) for (encoding, separator, names), some in alike.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), kinds)


def numeric_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, present, readable)``: filled cells of each text column and how many of them read as numbers, in one pass."""
    counts = [F.struct(F.lit(c).alias("column"), F.count_if(~is_blank(F.col(f"`{c}`"))).alias("present"), F.count_if(parse_number(F.col(f"`{c}`")).isNotNull()).alias("readable")) for c in columns]
    return df.agg(F.array(*counts).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def coerced(df: DataFrame, least: float = NUMERIC) -> tuple[DataFrame, dict[str, int]]:
    """``df`` with text columns of numbers as doubles, and for each of those the filled cells that could not be read. One pass decides for
    all columns; blanks of any kind become null there."""
    texts = [c for c, kind in df.dtypes if kind == "string"]
    if not texts:
        return df, {}
    found = {r.column: r.present - r.readable for r in numeric_shares(df, texts).collect() if r.readable and r.readable >= least * r.present}
    return df.select(*(parse_number(F.col(f"`{c}`")).alias(c) if c in found else F.col(f"`{c}`") for c in df.columns)), found


def sampled(df: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """The first rows, and how many there are."""
    return df.limit(limit), df.count()


def data_dictionary(df: DataFrame) -> DataFrame:
    """``(column, meaning)`` of a sheet that explains columns: its first two columns, stripped, without blanks; of repeats the first by
    meaning."""
    a, b = (strip(F.col(f"`{c}`").cast("string")) for c in df.columns[:2])
    return df.select(a.alias("column"), b.alias("meaning")).where(~is_blank(F.col("column")) & ~is_blank(F.col("meaning"))).groupBy("column").agg(F.min("meaning").alias("meaning"))


def is_dictionary(sheet: str) -> bool:
    """If a sheet is named like a data dictionary."""
    return any(w in sheet.lower() for w in ("từ điển", "tu dien", "dictionary", "data dict"))


def write_csv(df: DataFrame, path: str) -> None:
    """With headings, in the order of the columns; a file for each partition."""
    df.write.mode("overwrite").csv(path, header=True, emptyValue="")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def read_review(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame | None:
    """A stored match review, or None where one of the required columns is missing, so that it is made anew."""
    there = spark.read.csv(path, header=True).columns
    if set(required) - set(there):
        return None
    known = {f.split()[0]: f.split()[1] for f in schema.split(", ")}
    return spark.read.csv(path, header=True).select(*(F.col(c).try_cast(known[c]).alias(c) for c in known if c in there))


def remember(spark: SparkSession, folder: str, rows: DataFrame) -> None:
    """Appends ``rows(key, name, value, at)`` of choices or overrides to a store; nothing that is there changes."""
    rows.select(F.lower("key").alias("key"), F.lower("name").alias("name"), "value", "at").write.mode("append").parquet(folder)


def remembered(spark: SparkSession, folder: str) -> DataFrame:
    """``(key, name, value)``: what was stored last for each key and name."""
    stored = spark.read.schema("key string, name string, value string, at long").parquet(folder)
    return stored.groupBy("key", "name").agg(F.max_by("value", F.struct("at", "value")).alias("value"))
