"""Token ids in flat binary files with document offsets."""

from __future__ import annotations

import array
import functools
import itertools
import json
import operator
import os
import re
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import FileRange, file_in, new_path, stage, table

END_ID = 2
#: UTF-8 bytes of text for each file, about; small inputs still give each core a few files.
FILE_BYTES, FILES_PER_CORE = 128 << 20, 4
#: Documents whose ids are read back at once.
PAGE = 4096


# Fixed value: how the library's byte-level rule cuts a text before merging.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def cuts_into_pieces(tokenizer_json: str) -> bool:
    """If the tokenizer takes texts as they are and cuts them by the byte-level rule, across whose PIECES nothing merges."""
    told = json.loads(tokenizer_json)
    cut = told.get("pre_tokenizer") or {}
    plain = all(told.get(k) is None for k in ("normalizer", "post_processor", "truncation", "padding"))
    return plain and told["model"].get("type") == "BPE" and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True)


class Encoder:
    """Ids of whole texts by the tokenizers library, as bytes.

    Where `cuts_into_pieces` holds, a text is parted at each blank between two visible characters, where a piece always starts, and
    the parts into pieces; the library encodes each distinct piece. Parts and pieces met before are remembered, up to ROOM of either.
    Other tokenizers, and texts that hold a special token's string or one of the controls on which regular expression libraries
    differ, go to the library whole."""

    ROOM = 1_000_000
    #: Controls on which regular expression libraries differ, and white space besides the blank and the line end.
    CONTROLS = [*map(chr, range(0x1C, 0x20)), "\x85", "\u180e"]
    RARE_SPACES = ["\t", "\x0b", "\x0c", "\r", "\xa0", "\u1680", *map(chr, range(0x2000, 0x200B)), "\u2028", "\u2029", "\u202f", "\u205f", "\u3000"]

    def __init__(self, path: str, kind: str = "<u4"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.kind = Tokenizer.from_file(path), np.dtype(kind)
        self.by_pieces = cuts_into_pieces(self.tokenizer.to_str())
        self.special = [*(t.content for t in self.tokenizer.get_added_tokens_decoder().values()), *self.CONTROLS]
        self.slow_cut, self.find = re.compile(r" (?<=\S )(?=\S)").split, regex.compile(PIECES).findall
        self.parts: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.code = "H" if self.kind.itemsize == 2 else "I"

    def _cut(self, text: str) -> list[str]:
        """A text parted at each blank between two visible characters."""
        beside = "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " "
        return self.slow_cut(text) if beside or any(c in text for c in self.RARE_SPACES) else text.split(" ")

    def _bytes(self, ids: list[int]) -> bytes:
        out = array.array(self.code, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _ids(self, text: str) -> bytes:
        return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of each of many words with a blank in front, encoded as one text, where each is one piece."""
        e = self.tokenizer.encode("".join(words), add_special_tokens=False)
        of = np.array(e.word_ids)
        if not len(of) or of[-1] != len(words) - 1:
            return [self._ids(w) for w in words]
        data, size = self._bytes(e.ids), self.kind.itemsize
        ends = (np.searchsorted(of, np.arange(len(words)), "right") * size).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def _encoded(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, by its pieces."""
        if len(self.pieces) > self.ROOM:
            self.pieces.clear()
        known, cut = self.pieces, [self.find(t) for t in texts]
        new = {p for pieces in cut for p in pieces if p not in known}
        words = [p for p in new if p[0] == " " and p[1:].isalpha()]
        other = list(new.difference(words))
        known.update(zip(words, self._words(words)) if words else ())
        for p, e in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False)):
            known[p] = self._bytes(e.ids)
        return [b"".join([known[p] for p in pieces]) for pieces in cut]

    def __call__(self, text: str) -> bytes:
        if not self.by_pieces or any(c in text for c in self.special):
            return self._ids(text)
        first, *parts = self._cut(text)
        known = self.parts
        if len(known) > self.ROOM:
            known.clear()
        got = list(map(known.get, parts))
        if None in got:
            new = list(set(itertools.compress(parts, map(operator.not_, got))))
            for at in range(0, len(new), 4096):
                some = new[at : at + 4096]
                known.update(zip(some, self._encoded([f" {p}" for p in some])))
            got = map(known.__getitem__, parts)
        return b"".join([*self._encoded([first]), *got])


@functools.cache
def encoder(path: str, kind: str) -> Encoder:
    """One for each worker process: what it remembers serves all its tasks."""
    return Encoder(path, kind)


def id_bytes(tokenizer: str, end_id: int) -> int:
    """Bytes of an id in the files: 2 if all ids of the vocabulary and the end fit, else 4."""
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values()
    return 2 if max([*known, end_id]) < 1 << 16 else 4


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the ids of all texts, each followed by ``end_id``, in ascending id order, and returns the manifest
    ``(part, name, n_docs, n_null, n_ids, width, base)``: base counts the ids of all files before it, width is the bytes of an id.

    For each part, in the shared folder: ``name.bin``, ids as little-endian unsigned integers of 16 bits if the vocabulary
    fits, else 32; ``name.idx``, n + 1 little-endian unsigned 64-bit offsets of documents, in ids; ``name.doc``, their signed 64-bit
    document ids. Null ids come first (``n_null`` of a part, written as 0), null texts are empty; equal ids follow in the order of
    their texts' hashes, repeated rows are written as often as they come; other columns are ignored, whatever their names. Files are
    cut by bytes of text and streamed, a task holds one batch; a name belongs to one attempt, and the manifest names those that
    succeeded. Empty input: no files, an empty manifest.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    n_bytes = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    n = max(-(-n_bytes // file_bytes), FILES_PER_CORE * docs.sparkSession.sparkContext.defaultParallelism)
    ranged = rows.repartitionByRange(n, F.col("id").asc_nulls_first(), "h").sortWithinPartitions(F.col("id").asc_nulls_first(), "h").select("id", "text")

    width = id_bytes(tokenizer, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, encode, end = context.partitionId(), encoder(tokenizer, f"<u{width}"), np.array([end_id], f"<u{width}").tobytes()
        name = f"part-{part:06d}-{context.taskAttemptId()}"
        n_docs, n_null, at = 0, 0, 0
        fs, path = file_in(folder, name)
        fs.create_dir(os.path.dirname(path), recursive=True)
        with fs.open_output_stream(path + ".bin", buffer_size=1 << 20) as ids, fs.open_output_stream(path + ".idx", buffer_size=1 << 16) as idx, fs.open_output_stream(path + ".doc", buffer_size=1 << 16) as doc:
            idx.write(np.array([0], "<u8").tobytes())
            for b in batches:
                ends = []
                for text in b.column(1).to_pylist():
                    got = encode(text) + end
                    ids.write(got)
                    at += len(got) // width
                    ends.append(at)
                idx.write(np.array(ends, "<u8").tobytes())
                doc.write(b.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                n_docs, n_null = n_docs + b.num_rows, n_null + b.column(0).null_count
        if n_docs:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "name": [name], "n_docs": [n_docs], "n_null": [n_null], "n_ids": [at], "width": pa.array([width], pa.int32())})

    parts = stage(ranged.mapInArrow(run, "part int, name string, n_docs bigint, n_null bigint, n_ids bigint, width int"), "token-manifest")
    return parts.withColumn("base", F.sum("n_ids").over(Window.orderBy("part")) - F.col("n_ids"))


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of each document, from the files: a task for each file, some documents at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids, idx, doc = (FileRange(folder, r["name"] + end, kind) for end, kind in ((".bin", f"<u{r['width']}"), (".idx", "<u8"), (".doc", "<i8")))
                for at in range(0, r["n_docs"], PAGE):
                    to = min(at + PAGE, r["n_docs"])
                    starts, who = idx(at, to + 1).astype(np.int64), doc(at, to)
                    sums = [zlib.crc32(ids(s, e).astype("<u4")) for s, e in zip(starts[:-1].tolist(), starts[1:].tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(who, mask=np.arange(at, to) < r["n_null"]), pa.array(starts[:-1] + r["base"]), pa.array(np.diff(starts)), pa.array(sums, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    n = max(1, manifest.count())
    return manifest.repartition(n, "part").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op8_token_files(spark, sf_dir: str) -> DataFrame:
    """Contract: doc_id, start, n_tokens, ids_crc32, read back from the files."""
    import public_tokenizers

    folder = new_path(spark, "tokens")
    manifest = stage(write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder), "token-bases")
    return read_token_files(manifest, folder)
