"""Benchmark decontamination by size-partitioned MinHash containment search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_parts, table

SHINGLE = 5
CONTAINMENT = 0.8
#: Permutations. An item whose shingles a document holds to 0.8 has a Jaccard similarity of 0.19 or more with one of the windows
#: of its size class, so that no permutation agrees with a probability under 0.0013.
PERMUTATIONS = 32
#: Bytes of test items that go to the tasks at once; more items mean more passes over the documents.
BLOCK_BYTES = 32 << 20
BATCH = 1 << 20


def shingle_hashes(text: str | None, n: int = SHINGLE) -> list[int]:
    """XXH64 of each run of ``n`` words, in order, repeats included: A-Z lower-cased, words cut at ASCII blanks and joined by one
    blank. Texts with fewer words have none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) < n:
        return []
    joined, ends, at = b" ".join(words), [], 0
    for w in words:
        at += len(w)
        ends.append(at)
        at += 1
    starts = [0, *(e + 1 for e in ends[: len(words) - n])]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s:e]) for s, e in zip(starts, ends[n - 1 :])]


def permutations(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(0, 1 << 63, k, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, k, np.uint64)


def size_class(n_shingles: int) -> int:
    return 1 << max(0, (n_shingles - 1).bit_length())


class Items:
    """Test items, indexed by size class, permutation and minimum."""

    def __init__(self, items: list[tuple], k: int = PERMUTATIONS):
        self.a, self.b = permutations(k)
        self.ids, self.sets = [], []
        minima: dict[int, list[tuple[int, np.ndarray]]] = {}
        for item_id, text in items:
            hashes = shingle_hashes(text)
            if hashes:
                own = np.unique(np.array(hashes, np.uint64))
                minima.setdefault(size_class(len(hashes)), []).append((len(self.ids), (own[:, None] * self.a + self.b).min(axis=0)))
                self.ids.append(item_id)
                self.sets.append(own)
        self.index = {}
        for size, rows in sorted(minima.items()):
            per = []
            for p in range(k):
                values = np.array([m[p] for _, m in rows], np.uint64)
                order = np.argsort(values, kind="stable")
                per.append((values[order], np.array([rows[i][0] for i in order])))
            self.index[size] = per

    def candidates(self, hashes: np.ndarray, starts: np.ndarray) -> set[tuple[int, int]]:
        """(document, item): documents are runs of ``hashes`` from ``starts``, none empty. For a class, windows of twice its size
        at each multiple of it; a run of the class's size lies in one of them."""
        out: set[tuple[int, int]] = set()
        if not self.index:
            return out
        lengths = np.diff(np.append(starts, len(hashes)))
        cuts = {}
        for size in self.index:
            n = -(-lengths // size)
            who = np.repeat(np.arange(len(starts)), n)
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            cuts[size] = (starts[who] + place * size, who)
        for p in range(len(self.a)):
            mixed = hashes * self.a[p] + self.b[p]
            for size, per in self.index.items():
                at, who = cuts[size]
                block = np.minimum.reduceat(mixed, at)
                window = block.copy()
                same = who[1:] == who[:-1]
                window[:-1][same] = np.minimum(block[:-1][same], block[1:][same])
                values, items = per[p]
                low = np.searchsorted(values, window)
                hit = np.flatnonzero(values[np.minimum(low, len(values) - 1)] == window)
                for w, lo, hi in zip(who[hit].tolist(), low[hit].tolist(), np.searchsorted(values, window[hit], "right").tolist()):
                    out.update((w, i) for i in items[lo:hi].tolist())
        return out

    def search(self, texts: list[str | None]) -> list[tuple[int, int, int]]:
        """(document, item, shared shingles) with the containment verified on all shingles of the whole document."""
        out, hashes, starts, docs, held = [], [], [], [], 0

        def flush() -> None:
            if not docs:
                return
            flat = np.concatenate(hashes)
            own = {}
            for d, item in sorted(self.candidates(flat, np.array(starts))):
                if d not in own:
                    own = {d: np.unique(hashes[d])}
                shared = int(np.isin(self.sets[item], own[d], assume_unique=True).sum())
                if shared >= CONTAINMENT * len(self.sets[item]):
                    out.append((docs[d], item, shared))
            hashes.clear(), starts.clear(), docs.clear()

        for i, text in enumerate(texts):
            got = shingle_hashes(text)
            if got:
                starts.append(held)
                hashes.append(np.array(got, np.uint64))
                docs.append(i)
                held += len(got)
            if held >= BATCH:
                flush()
                held = 0
        flush()
        return out


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple]]:
    """Test items in blocks of about ``block_bytes``, by hash: what tasks get at once stays bounded, however many there are."""
    rows = items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t is not null").distinct()
    total = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("n")).first().n
    n = 1 + total // block_bytes
    for k in range(n):
        yield [(r.i, r.t) for r in rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()]


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(doc_id, item_id, n_item, n_shared, containment)`` for each document row and test item of which it holds 0.8 or more of the
    distinct shingles. Documents are never shuffled.

    Null texts and texts under five words, on either side, hold nothing and are held by nothing; null ids and repeated document
    rows stay, repeated items count once; other columns are ignored. Empty tables give no rows.
    """
    out = None
    for block in item_blocks(items, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Items(shared.value)
            for b in in_parts(batches):
                found = index.search(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array([d for d, _, _ in found], pa.int64())), pa.array([index.ids[i] for _, i, _ in found], pa.int64()),
                     pa.array([len(index.sets[i]) for _, i, _ in found], pa.int64()), pa.array([n for _, _, n in found], pa.int64())],
                    ["doc_id", "item_id", "n_item", "n_shared"],
                )

        part = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, item_id bigint, n_item bigint, n_shared bigint")
        out = part if out is None else out.union(part)
    return out.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def drop_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that hold no test item; the same search and edge cases as `find_leaks`."""
    place = docs.columns.index(text_col)
    for block in item_blocks(items, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Items(shared.value)
            for b in in_parts(batches):
                leaked = {d for d, _, _ in index.search(b.column(place).to_pylist())}
                yield b.filter(pa.array([i not in leaked for i in range(b.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items: doc_id, item_id, n_item, n_shared, containment."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP10_SQL = r"""
WITH w AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') FROM benchmark),
s AS (SELECT DISTINCT side, id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT side, id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
b AS (SELECT id AS item_id, g, count(*) OVER (PARTITION BY id) AS n_item FROM s WHERE side = 'b')
SELECT s.id AS doc_id, item_id, n_item::BIGINT AS n_item, count(*)::BIGINT AS n_shared, count(*)::DOUBLE / n_item AS containment
FROM s JOIN b ON s.g = b.g WHERE s.side = 'd' GROUP BY s.id, item_id, n_item HAVING count(*) >= 0.8 * n_item
"""
