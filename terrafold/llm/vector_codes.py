"""Vector codes: a codebook for each part of the vectors, its entries searched through a vantage-point tree with exact distances."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stage, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Entries below which a node of the tree is a leaf, and vectors searched at once.
LEAF, BLOCK = 16, 8192
#: Components are below this, so that squared distances fit in 64 bits.
MOST = 1 << 25
#: Rows of label sums that are broadcast; more are joined by a shuffle.
LABELS_AT_HAND = 100_000


class Node(NamedTuple):
    """A vantage entry and bounds, rounded outward, of the distances from it to the entries of either child; or a leaf."""

    entries: np.ndarray
    bounds: tuple[tuple[float, float], ...] = ()
    children: tuple[Node, ...] = ()


def squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer points to integer entries. Where all sums stay below 2 to the 53rd, in floating point."""
    most = max(np.abs(points).max(initial=0), np.abs(entries).max(initial=0))
    if 4 * int(most) ** 2 * max(1, points.shape[1]) < 1 << 53:
        p, e = points.astype(np.float64), entries.astype(np.float64)
        return ((p * p).sum(1)[:, None] - 2 * (p @ e.T) + (e * e).sum(1)[None]).astype(np.int64)
    return np.stack([((points - e) ** 2).sum(1) for e in entries], 1)


def _outward(low: float, high: float) -> tuple[float, float]:
    """A range of roots made surely wide enough."""
    return low * (1 - 1e-12) - 1e-9, high * (1 + 1e-12) + 1e-9


def plant(book: np.ndarray, entries: np.ndarray | None = None) -> Node:
    """The vantage-point tree over the rows of ``book``: each node takes its first entry and halves the others by their distance to it."""
    entries = np.arange(len(book)) if entries is None else entries
    if len(entries) <= LEAF:
        return Node(entries)
    rest = entries[1:]
    far = squared(book[rest], book[entries[:1]])[:, 0]
    order = np.argsort(far, kind="stable")
    halves = np.array_split(order, 2)
    bounds = tuple(_outward(float(np.sqrt(far[h].min())), float(np.sqrt(far[h].max()))) for h in halves)
    return Node(entries[:1], bounds, tuple(plant(book, rest[h]) for h in halves))


def nearest(points: np.ndarray, book: np.ndarray, tree: Node) -> tuple[np.ndarray, np.ndarray]:
    """For each point the nearest row of ``book`` (ties: the lower index) and the squared distance, by branch and bound.

    A first descent takes each point to the nearer child at every node. The second visits every child that may hold an entry as near
    as the best so far: bounds are rounded outward and an equal bound is visited, so ties are seen; distances compare as integers.
    """
    best = np.full(len(points), np.iinfo(np.int64).max)
    index = np.zeros(len(points), np.int64)

    def look(node: Node, who: np.ndarray) -> np.ndarray:
        d = squared(points[who], book[node.entries])
        least = d.min(1)
        first = np.where(d == least[:, None], node.entries[None], len(book)).min(1)
        better = (least < best[who]) | ((least == best[who]) & (first < index[who]))
        best[who[better]], index[who[better]] = least[better], first[better]
        return np.sqrt(d[:, 0].astype(np.float64))

    def below(bounds: tuple[float, float], d: np.ndarray) -> np.ndarray:
        """Least possible distance of a point at distance d from the vantage entry."""
        return np.maximum(np.maximum(bounds[0] - d, d - bounds[1]), 0)

    def descend(node: Node, who: np.ndarray) -> None:
        d = look(node, who)
        if node.children:
            left = below(node.bounds[0], d) <= below(node.bounds[1], d)
            for child, mine in zip(node.children, (who[left], who[~left])):
                if len(mine):
                    descend(child, mine)

    def visit(node: Node, who: np.ndarray) -> None:
        d = look(node, who)
        for child, bounds in zip(node.children, node.bounds):
            reach = np.sqrt(best[who].astype(np.float64)) * (1 + 1e-12) + 1e-9
            mine = who[below(bounds, d) <= reach]
            if len(mine):
                visit(child, mine)

    everyone = np.arange(len(points))
    if len(points):
        descend(tree, everyone)
        visit(tree, everyone)
    return index, best


def _cuts(width: int, parts: int) -> list[tuple[int, int]]:
    at = [width * k // parts for k in range(parts + 1)]
    return list(zip(at, at[1:]))


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _search(q: np.ndarray, books: list[np.ndarray], trees: list[Node], cuts: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared distances) of whole vectors: a column for each part."""
    found = [[nearest(q[at : at + BLOCK, a:b], book, tree) for at in range(0, len(q), BLOCK)] for (a, b), book, tree in zip(cuts, books, trees)]
    return tuple(np.stack([np.concatenate([x[k] for x in part]) for part in found], 1) for k in (0, 1))


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE) -> DataFrame:
    """``(vec_id, label, q)``: components as integers, floor(scale * x), of the rows whose vector and all its components are finite.

    A component that becomes 2 to the 25th or more raises an error: squared distances would not fit in 64 bits."""
    x = F.col("x")
    doubles = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    finite = doubles.where(x.isNotNull() & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))))
    small = F.forall("x", lambda c: F.abs(c * scale) < MOST)
    return finite.select("vec_id", "label", F.when(small, F.transform("x", lambda c: F.floor(c * scale).cast("int"))).otherwise(F.raise_error(F.lit("a component is too large for 64-bit distances"))).alias("q"))


def fit_codebooks(whole: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """A codebook for each part, from ``whole(vec_id, label, q)``: the first vectors' parts, moved ``rounds`` times to their mean.

    What comes to the driver and goes to tasks is the codebooks, ``entries`` vectors in all, whatever the input; each task sends a row
    of sums for each entry that it used, and sums of whole numbers do not depend on the order. Vectors of another length than the first
    one that has components are left out. No vectors: no codebooks.
    """
    if entries > 256:
        raise ValueError("two hex digits tell 256 entries apart")
    spark, order = whole.sparkSession, (F.col("vec_id").asc_nulls_last(), "q")
    head = whole.where("size(q) > 0").orderBy(*order).select(F.size("q").alias("width")).first()
    if not head:
        return []
    whole = whole.where(F.size("q") == head.width)
    first = np.array([r.q for r in whole.orderBy(*order).limit(entries).select("q").collect()], np.int64)
    cuts = _cuts(first.shape[1], parts)
    books, most = [first[:, a:b].copy() for a, b in cuts], max(b - a for a, b in cuts)
    schema = f"part int, entry int, n long, {', '.join(f's{k} long' for k in range(most))}"

    for _ in range(rounds):
        held = spark.sparkContext.broadcast((books, [plant(b) for b in books]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, trees = held.value
            n, sums = np.zeros((parts, len(first)), np.int64), np.zeros((parts, len(first), most), np.int64)
            for b in batches:
                q = _matrix(b.column(0), first.shape[1])
                codes, _ = _search(q, now, trees, cuts)
                for p, (lo, hi) in enumerate(cuts):
                    np.add.at(sums[p, :, : hi - lo], codes[:, p], q[:, lo:hi])
                    n[p] += np.bincount(codes[:, p], minlength=len(first))
            part, entry = np.nonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(n[part, entry]), *(pa.array(sums[part, entry, k]) for k in range(most))], ["part", "entry", "n", *(f"s{k}" for k in range(most))]
            )

        moved = whole.select("q").mapInArrow(run, schema).groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(f"s{k}").alias(f"s{k}") for k in range(most)))
        books = [b.copy() for b in books]
        for r in moved.collect():
            a, b = cuts[r.part]
            books[r.part][r.entry] = [r[f"s{k}"] // r.n for k in range(b - a)]
        held.unpersist()
    return books


def encode_vectors(whole: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """``whole(vec_id, label, q)`` to ``(vec_id, label, code, error)``: the index of each part's nearest entry, two hex digits each, and the
    squared distances, summed over parts; null for vectors of another length."""
    cuts = _cuts(sum(b.shape[1] for b in books), len(books))
    held = whole.sparkSession.sparkContext.broadcast((books, [plant(b) for b in books]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, trees = held.value
        for b in batches:
            fits = np.diff(b.column(2).offsets.to_numpy()) == cuts[-1][1]
            codes, errors = _search(_matrix(b.column(2).filter(pa.array(fits)), cuts[-1][1]), now, trees, cuts)
            text, far = np.full(b.num_rows, None, object), np.zeros(b.num_rows, np.int64)
            text[fits], far[fits] = [x.tobytes().hex() for x in codes.astype(np.uint8)], errors.sum(1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(far, mask=~fits)], ["vec_id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in whole.schema}
    return whole.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """``(vec_id, label, code, error, label_error)`` of each vector that is whole and finite, and the codebooks.

    Vectors of another length than the first kept one that has components get null for code and error. Ties go to the lower index, repeated rows count each, null ids come
    last among the first entries and null labels together, other columns are ignored. A length that four does not divide is cut at
    its quarters, rounded down. Empty input: no rows, no codebooks. Sums by label combine before the shuffle; few labels are
    broadcast, more are joined by their key.
    """
    whole = stage(whole_vectors(vectors, id_col, vector_col, label_col), "whole-vectors")
    books = fit_codebooks(whole)
    if not books:
        return whole.select("vec_id", "label", F.lit(None).cast("string").alias("code"), *(F.lit(None).cast("long").alias(c) for c in ("error", "label_error"))), books
    coded = stage(encode_vectors(whole, books), "vector-codes")
    sums = stage(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    discard(whole)
    few = sums.count() <= LABELS_AT_HAND
    return coded.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("of"))).drop("of"), books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' decimal components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def op12_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Contract: vec_id, code, error, label_error, codebooks_sha256."""
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """The rounds one after the other, every entry tried for every part."""
    steps = [
        "kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding))",
        "parts AS (SELECT row_number() OVER () AS i, p, q[len(q) // 4 * p + 1 : len(q) // 4 * (p + 1)] AS v, vec_id, label FROM kept, range(4) r(p))",
        "book0 AS (SELECT p, (row_number() OVER (PARTITION BY p ORDER BY vec_id, v) - 1)::BIGINT AS e, v AS c FROM (SELECT p, v, vec_id, row_number() OVER (PARTITION BY p ORDER BY vec_id, v) AS k FROM parts) WHERE k <= 256)",
    ]
    for k in range(5):
        steps.append(
            f"near{k} AS (SELECT i, any_value(parts.p) AS p, any_value(v) AS v, any_value(vec_id) AS vec_id, any_value(label) AS label, "
            f"min({{'d': list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'e': e}}) AS m FROM parts JOIN book{k} ON parts.p = book{k}.p GROUP BY i)"
        )
        if k < 4:
            steps.append(
                f"mean{k} AS (SELECT p, e, list(x ORDER BY j) AS c FROM (SELECT p, m.e AS e, j, floor(sum(v[j]) / count(*))::BIGINT AS x FROM near{k}, LATERAL (SELECT unnest(range(1, len(v) + 1)) AS j) GROUP BY ALL) GROUP BY ALL)"
            )
            steps.append(f"book{k + 1} AS (SELECT p, e, coalesce(mean{k}.c, book{k}.c) AS c FROM book{k} LEFT JOIN mean{k} USING (p, e))")
    steps.append("coded AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM near4 GROUP BY vec_id)")
    steps.append("books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book4)")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded, books"


OP12_SQL = _sql()
