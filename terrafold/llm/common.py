"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import discard, merged_joins, new_path, shared_dir, stage

#: What separates words: the space and the controls from tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Most bits of a `sieve`, as a power of two: 32 MB; words of one of its files: 512 KB.
SIEVE_BITS, SIEVE_PIECE = 28, 1 << 16

#: Bytes of rows that a Python worker takes at once, about, in `in_parts` and `small_batches`.
PART_BYTES = 2 << 20


def in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of all batches, in order, in parts of about PART_BYTES: what is made of a part goes before the next one's is made."""
    for b in batches:
        rows = -(-b.num_rows // (1 + b.nbytes // PART_BYTES))
        yield from (b.slice(at, rows) for at in range(0, b.num_rows, max(1, rows)))


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """While it lasts, the session's Arrow batches have about PART_BYTES. What is to be mapped like that must be staged in it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(PART_BYTES))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared one."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def file_in(folder: str, name: str) -> tuple[pafs.FileSystem, str]:
    fs, path = pafs.FileSystem.from_uri(folder)
    return fs, f"{path.rstrip('/')}/{name}"


class FileRange:
    """Ranges of a file as numpy values: mapped into memory where the file system is local, else read range by range."""

    def __init__(self, folder: str, name: str, kind: str):
        fs, path = file_in(folder, name)
        self.kind, self.mapped, self.file = np.dtype(kind), None, None
        if not isinstance(fs, pafs.LocalFileSystem):
            self.file = fs.open_input_file(path)
        elif os.path.getsize(path):
            self.mapped = np.memmap(path, self.kind, "r")

    def __call__(self, start: int, end: int) -> np.ndarray:
        if self.file is None:
            return self.mapped[start:end] if self.mapped is not None else np.zeros(0, self.kind)
        self.file.seek(start * self.kind.itemsize)
        return np.frombuffer(self.file.read((end - start) * self.kind.itemsize), self.kind)


def sieve(keys: DataFrame, column: str) -> tuple[str, int, list[tuple[int, str]]]:
    """A bitmap of the low bits of the 64-bit hashes in a column, for `passes`: what it stops is surely none of them. Sixty-four bits a
    key, 2 to the SIEVE_BITS at most; of more keys it lets more through. Tasks write it in pieces to the shared folder, where `bitmap`
    reads it: (folder, words, pieces) is all that the driver sees."""
    spark, words = keys.sparkSession, (1 << min(max(10, (64 * keys.count()).bit_length()), SIEVE_BITS)) // 64
    slot, folder = F.col(column).bitwiseAND(F.lit(64 * words - 1)), new_path(spark, "sieve")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, found = TaskContext.get(), {}
        for b in batches:
            word, bits = (b.column(k).to_numpy() for k in (0, 1))
            for piece in np.unique(word // SIEVE_PIECE).tolist():
                own = word // SIEVE_PIECE == piece
                found.setdefault(piece, np.zeros(min(SIEVE_PIECE, words), "<i8"))[word[own] % SIEVE_PIECE] = bits[own]
        names = [f"piece-{piece}-{context.taskAttemptId()}" for piece in found]
        for name, piece in zip(names, found.values()):
            fs, path = file_in(folder, name)
            fs.create_dir(path.rpartition("/")[0], recursive=True)
            with fs.open_output_stream(path) as out:
                out.write(piece.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(names, pa.string())], ["piece", "name"])

    per_word = keys.select(slot.alias("slot")).select(F.shiftright("slot", 6).alias("word"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    dealt = per_word.repartition(-(-words // SIEVE_PIECE), F.floor(F.col("word") / SIEVE_PIECE))
    return folder, words, [(r.piece, r.name) for r in dealt.mapInArrow(write, "piece long, name string").collect()]


def bitmap(of: tuple[str, int, list[tuple[int, str]]]) -> np.ndarray:
    """The bitmap of a `sieve`. A task reads it once and lets it go at its end: Python workers live on, and nothing else would free it."""
    folder, words, pieces = of
    out = np.zeros(words, np.uint64)
    for piece, name in pieces:
        out[piece * SIEVE_PIECE : (piece + 1) * SIEVE_PIECE] = FileRange(folder, name, "<u8")(0, min(SIEVE_PIECE, words))
    return out


def passes(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the uint64 ``keys`` may be among those of a `sieve`."""
    slot = keys & np.uint64(64 * len(bitmap) - 1)
    return (bitmap[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words_of(c: Column) -> Column:
    """array<string>: the words of a text; empty for null or blank texts."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), BLANK_CLASS + "+"), lambda w: w != "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_row_id(df: DataFrame) -> tuple[DataFrame, str]:
    """Adds, under a free name, the row's file (hashed) and place in it: the same each time the table is read, whatever its splits.
    ``df`` must come straight from a scan of Parquet files."""
    name, meta = fresh(df, "row_id"), df.metadataColumn("_metadata")
    return df.withColumn(name, F.struct(F.xxhash64(meta["file_path"]).alias("f"), meta["row_index"].alias("i"))), name


#: Words of 64 rows that are broadcast in `without_rows`: 25 MB, about.
WORDS_AT_HAND = 100_000


def without_rows(keyed: DataFrame, row: str, gone: DataFrame) -> DataFrame:
    """``keyed``, from `with_row_id`, without the rows that the one column of ``gone`` names, and without the column ``row``. Rows that
    go are bits of words of 64 rows; few words are broadcast, more are joined by a shuffle: an estimate by the file of so narrow a
    table is many times too low."""
    bit = lambda at: F.expr(f"shiftleft(1L, cast({at} & 63 as int))")
    words = stage(gone.toDF("r").select("r.f", "r.i").groupBy("f", F.shiftright("i", 6).alias("w")).agg(F.bit_or(bit("i")).alias("bits")), "gone-rows")
    few = F.broadcast(words) if words.count() <= WORDS_AT_HAND else words.hint("merge")
    of = few.select(F.struct("f", "w").alias(word := fresh(keyed, "word")), F.col("bits").alias(bits := fresh(keyed, "bits")))
    at = keyed.withColumn(word, F.struct(F.col(row)["f"].alias("f"), F.shiftright(F.col(row)["i"], 6).alias("w")))
    return at.join(of, word, "left").where(F.coalesce(F.col(bits).bitwiseAND(bit(f"`{row}`.i")), F.lit(0)) == 0).drop(row, word, bits)
