"""Large delimited files read by many tasks: byte ranges, whose quotes are counted first, give the true ends of lines."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .shapefile import _open

#: Bytes of a file that one task reads, about, and bytes that it reads at once.
RANGE_BYTES, STEP = 32 << 20, 1 << 20
MARKS = re.compile(rb'["\n]').finditer


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, size: int, quoted: bool, number: int):
        self.path, self.start, self.end, self.size, self.quoted, self.number = path, start, end, size, quoted, number


def steps(path: str, start: int, end: int) -> Iterator[bytes]:
    """The bytes of a stretch of a file, some at a time."""
    fs, at = _open(path)
    with fs.open_input_file(at) as f:
        f.seek(start)
        while start < end:
            some = f.read(min(STEP, end - start))
            if not some:
                return
            start += len(some)
            yield some


def ranges_of(files: list[tuple[str, int]], range_bytes: int) -> list[tuple[str, int, int, int]]:
    """(path, start, end, size) of the ranges of files."""
    out = []
    for path, size in files:
        n = max(1, -(-size // range_bytes))
        cuts = [size * k // n for k in range(n + 1)]
        out += [(path, a, b, size) for a, b in zip(cuts, cuts[1:])]
    return out


def quote_counts(spark: SparkSession, ranges: list[tuple[str, int, int, int]]) -> list[int]:
    """How many quotes each range has: a task reads its range and returns a number."""
    df = spark.createDataFrame([(k, p, a, b) for k, (p, a, b, _) in enumerate(ranges)], "k int, path string, a long, b long").repartition(max(1, len(ranges)), "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                n = sum(some.count(b'"') for some in steps(r["path"], r["a"], r["b"]))
                yield pa.RecordBatch.from_pydict({"k": pa.array([r["k"]], pa.int32()), "n": pa.array([n], pa.int64())})

    found = {r.k: r.n for r in df.mapInArrow(run, "k int, n long").collect()}
    return [found[k] for k in range(len(ranges))]


class LineReader(DataSourceReader):
    def __init__(self, options: dict):
        self.ranges = [line.split("\t") for line in options["ranges"].split("\n")]
        self.encoding, self.separator, self.columns = options["encoding"], options["separator"], int(options["columns"])

    def partitions(self) -> list[Range]:
        return [Range(p, int(a), int(b), int(size), q == "1", k) for k, (p, a, b, size, q) in enumerate(self.ranges)]

    def _own(self, r: Range) -> Iterator[bytes]:
        """The bytes of the records that begin in a range. A record begins at the file's start and after each line end outside quotes."""
        begun = r.start == 0 or (not r.quoted and b"".join(steps(r.path, r.start - 1, r.start)) == b"\n")
        quoted, at = r.quoted, r.start
        for some in steps(r.path, r.start, r.size):
            out_from = 0
            for m in MARKS(some):
                if m[0] == b'"':
                    quoted = not quoted
                elif not quoted:
                    if begun and at + m.end() >= r.end:
                        yield some[out_from : m.end()]
                        return
                    if not begun:
                        if at + m.end() >= r.end:
                            return
                        begun, out_from = True, m.end()
            if begun:
                yield some[out_from:]
            at += len(some)

    def read(self, r: Range) -> Iterator[tuple]:
        class Raw(io.RawIOBase):
            def __init__(self, chunks):
                self.chunks, self.held = chunks, b""

            def readable(self):
                return True

            def readinto(self, into):
                while not self.held:
                    self.held = next(self.chunks, None)
                    if self.held is None:
                        self.held = b""
                        return 0
                n = min(len(into), len(self.held))
                into[:n], self.held = self.held[:n], self.held[n:]
                return n

        text = io.TextIOWrapper(io.BufferedReader(Raw(self._own(r))), encoding=self.encoding, errors="replace", newline="")
        csv.field_size_limit(1 << 30)
        for k, row in enumerate(csv.reader(text, delimiter=self.separator)):
            if (r.start == 0 and k == 0) or not row:
                continue
            yield tuple((row[c] or None) if c < len(row) else None for c in range(self.columns))


class LineSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quoted_lines"

    def schema(self) -> str:
        return ", ".join(f"c{k} string" for k in range(int(self.options["columns"])))

    def reader(self, schema) -> LineReader:
        return LineReader(self.options)


def read_ranges(spark: SparkSession, files: list[tuple[str, int]], columns: int, separator: str, encoding: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(c0, c1, ..)`` as text of all records of ``files(path, size)`` but each one's first, in which quotes may hold separators and line ends.

    A first pass counts the quotes of each range of bytes; sums over the ranges of a file say which ranges begin inside quotes, so each
    task finds the first true line end in its range by itself and reads on to that of the next. Only a number for each range is on
    the driver. A file whose quotes don't pair up is read by one task. Empty cells are null, short records are filled up, longer ones
    cut. Encodings whose quotes and line ends are single
    bytes, as UTF-8 and code pages are; a quote stands for itself when doubled.
    """
    ranges = ranges_of(files, range_bytes)
    counts, total, upto = quote_counts(spark, ranges), {}, {}
    for (path, *_), n in zip(ranges, counts):
        total[path] = total.get(path, 0) + n
    # Stray quotes make an odd number: such a file is read as one range.
    odd = {p for p, n in total.items() if n % 2}
    lines = []
    for (path, a, b, size), n in zip(ranges, counts):
        if path in odd:
            if not a:
                lines.append(f"{path}\t0\t{size}\t{size}\t0")
            continue
        lines.append(f"{path}\t{a}\t{b}\t{size}\t{upto.get(path, 0) % 2}")
        upto[path] = upto.get(path, 0) + n
    spark.dataSource.register(LineSource)
    options = {"ranges": "\n".join(lines), "encoding": encoding, "separator": separator, "columns": str(columns)}
    return spark.read.format("quoted_lines").options(**options).load()
