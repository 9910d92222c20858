"""Natural breaks: Fisher's exact division of a column's distinct values, block by block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import discard, stage

#: Distinct values of a block, and most blocks: what the driver holds is a few numbers for each block, whatever the input.
BLOCK, MOST_BLOCKS = 4096, 16384
#: Ends of blocks are placed in rounds, each round every so many of those that are open.
STRIDE = 128
#: Costs that are worked out at once.
AT_ONCE = 1 << 16

ROWS = "b int, start long, w array<double>, s array<double>, q array<double>, d array<double>"


def costs(ends: np.ndarray, splits: np.ndarray) -> np.ndarray:
    """Squared deviation of the values after a split up to an end, and what the division before the split costs. ``ends`` has rows (place, w,
    s, q) of running sums, ``splits`` (place, w, s, q, d); a split at or after the end costs infinity."""
    with np.errstate(divide="ignore", invalid="ignore"):
        w, s, q = (ends[k][:, None] - splits[k][None] for k in (1, 2, 3))
        out = splits[4][None] + np.maximum(q - s * s / w, 0.0)
    return np.where(splits[0][None] < ends[0][:, None], out, np.inf)


def best_splits(ends: np.ndarray, splits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cost, place) of the best split for each end: where ends ascend, the first best split never goes back, so the middle end's bounds the
    others'; small enough pieces are tried whole."""
    cost, place = np.full(ends.shape[1], np.inf), np.full(ends.shape[1], -1.0)
    open_ = [(0, ends.shape[1], 0, splits.shape[1])]
    while open_:
        a, b, lo, hi = open_.pop()
        if a >= b or lo >= hi:
            continue
        middle = (a + b) // 2
        some = slice(a, b) if (b - a) * (hi - lo) <= AT_ONCE else slice(middle, middle + 1)
        tried = costs(ends[:, some], splits[:, lo:hi])
        at = tried.argmin(1)
        cost[some] = tried[np.arange(len(at)), at]
        place[some] = np.where(np.isfinite(cost[some]), splits[0, lo:hi][at], -1.0)
        if some.stop - some.start < b - a:
            cut = lo + int(at[0])
            # Before the middle end a split at it can't count; after it none before the best does.
            open_ += [(a, middle, lo, cut + 1 if np.isfinite(cost[middle]) else hi), (middle + 1, b, cut if np.isfinite(cost[middle]) else lo, hi)]
    return cost, place


def _columns(b: pa.RecordBatch, k: int, names: tuple[str, ...]) -> list[np.ndarray]:
    return [b.column(b.schema.get_field_index(n))[k].values.to_numpy(zero_copy_only=False) for n in names]


def _places(start: int, n: int) -> np.ndarray:
    return start + 1.0 + np.arange(n)


def _blocks(data: DataFrame, column: str, times: str | None) -> tuple[DataFrame, np.ndarray, float]:
    """The distinct values with running sums as blocks ``(b, start, w, s, q, d)``, ``d`` the cost of one class up to each value; for each block
    (start, end, w, s, q) at its end; and the middle that was taken off the values."""
    counted = stage(data.groupBy(F.col(column).alias("x")).agg((F.sum(times) if times else F.count("*")).alias("n")), "value-counts")
    told = counted.agg(F.count("*").alias("n"), F.try_divide(F.sum(F.col("x") * F.col("n")), F.sum("n")).alias("mean")).first()
    block, middle = max(BLOCK, -(-told.n // MOST_BLOCKS)), float(told.mean)
    ranged = counted.repartitionByRange(max(1, -(-told.n // block)), "x").withColumn("pid", F.spark_partition_id()).sortWithinPartitions("x")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, n, pid, seq = np.zeros(0), np.zeros(0), -1, 0

        def out(x: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            w, s, q = (np.cumsum(v) for v in (n, n * x, n * x * x))
            return pa.RecordBatch.from_pydict({"pid": pa.array([pid], pa.int32()), "seq": pa.array([seq], pa.int32()), "n": [len(x)], "w": [w], "s": [s], "q": [q]})

        for b in batches:
            if b.num_rows:
                pid = b.column(2)[0].as_py()
            x, n = np.concatenate((x, b.column(0).to_numpy() - middle)), np.concatenate((n, b.column(1).to_numpy().astype(float)))
            while len(x) >= block:
                yield out(x[:block], n[:block])
                x, n, seq = x[block:], n[block:], seq + 1
        if len(x):
            yield out(x, n)

    raw = stage(ranged.mapInArrow(cut, "pid int, seq int, n long, w array<double>, s array<double>, q array<double>"), "value-blocks")
    last = lambda c: F.element_at(c, -1).alias(c)
    rows = raw.select("pid", "seq", "n", last("w"), last("s"), last("q")).orderBy("pid", "seq").collect()
    sums = np.array([(r.n, r.w, r.s, r.q) for r in rows], float).reshape(-1, 4)
    upto = np.cumsum(sums, axis=0)
    before = upto - sums
    place = {(r.pid, r.seq): (k, *before[k].tolist()) for k, r in enumerate(rows)}

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                at, start, w0, s0, q0 = place[b.column(0)[k].as_py(), b.column(1)[k].as_py()]
                w, s, q = (v + v0 for v, v0 in zip(_columns(b, k, ("w", "s", "q")), (w0, s0, q0)))
                yield pa.RecordBatch.from_pydict({"b": pa.array([at], pa.int32()), "start": [int(start)], "w": [w], "s": [s], "q": [q], "d": [np.maximum(q - s * s / w, 0.0)]})

    out = stage(raw.mapInArrow(shift, ROWS), "running-sums")
    discard(counted, raw)
    return out, np.concatenate((before[:, :1], upto), 1), middle


def _place_ends(cand: DataFrame, ends: np.ndarray) -> np.ndarray:
    """The best split of each block's end, over all blocks of ``cand``: those of every so many ends first, then of those between, whose splits
    lie between theirs."""
    n_blocks, found = len(ends), {}
    strides = [s for s in (STRIDE**2, STRIDE) if s < n_blocks] + [1]
    for stride in strides:
        new = [k for k in range(n_blocks) if (n_blocks - 1 - k) % stride == 0 and k not in found]
        known = sorted(found)
        low, high = [], []
        for k in new:
            below, above = [p for p in known if p < k][-1:], [p for p in known if p > k][:1]
            low.append(found[below[0]] if below else -1.0)
            high.append(found[above[0]] if above else np.inf)
        wanted, low_, high_ = np.array(new), np.array(low), np.array(high)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in range(b.num_rows):
                    w, s, q, d = _columns(b, k, ("w", "s", "q", "d"))
                    splits = np.stack([_places(b.column(1)[k].as_py(), len(w)), w, s, q, d])
                    mine = (ends[wanted, 1] > splits[0, 0]) & (low_ <= splits[0, -1]) & (high_ >= splits[0, 0])
                    if mine.any():
                        cost, at = best_splits(ends[wanted[mine], 1:].T, splits)
                        good = at >= 0
                        yield pa.RecordBatch.from_pydict({"b": pa.array(wanted[mine][good].astype(np.int32)), "cost": cost[good], "at": at[good]})

        best = cand.mapInArrow(run, "b int, cost double, at double").groupBy("b").agg(F.min(F.struct("cost", "at"))["at"].alias("at"))
        found |= dict.fromkeys(new, -1.0) | {r.b: r.at for r in best.collect()}
    return np.array([found[k] for k in range(n_blocks)])


def _next_level(cand: DataFrame, ends: np.ndarray) -> DataFrame:
    """``cand``'s blocks with ``d`` for one class more, and ``at``, the best last split for each value."""
    spark = cand.sparkSession
    at = _place_ends(cand, ends)
    low = np.concatenate(([-1.0], at[:-1]))
    block_of = lambda p: int(np.searchsorted(ends[:, 1], p))
    meet = [(b, c) for b in range(len(ends)) if at[b] >= 0 for c in range(block_of(max(low[b], 1.0)), block_of(at[b]) + 1)]
    # At most two pairs for each block on average, since splits never go back.
    pairs = spark.createDataFrame(meet or [(0, 0)], "b int, c int")
    target = cand.select("b", "start", "w", "s", "q")
    split = cand.select(F.col("b").alias("c"), *(F.col(k).alias(f"c_{k}") for k in ("start", "w", "s", "q", "d")))
    joined = target.join(pairs, "b").join(split, "c").select("b", "start", "w", "s", "q", "c_start", "c_w", "c_s", "c_q", "c_d", "c")
    sorted_ = joined.repartition(max(1, min(len(ends), 4 * spark.sparkContext.defaultParallelism)), "b").sortWithinPartitions("b", "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best, place, row = None, None, None, None

        def out() -> pa.RecordBatch:
            start, w, s, q = row
            return pa.RecordBatch.from_pydict({"b": pa.array([now], pa.int32()), "start": [start], "w": [w], "s": [s], "q": [q], "d": [best], "at": [place]})

        for b in batches:
            for k in range(b.num_rows):
                if b.column(0)[k].as_py() != now:
                    if now is not None:
                        yield out()
                    now, start = b.column(0)[k].as_py(), b.column(1)[k].as_py()
                    w, s, q = _columns(b, k, ("w", "s", "q"))
                    row, best, place = (start, w, s, q), np.full(len(w), np.inf), np.full(len(w), -1.0)
                    target = np.stack([_places(start, len(w)), w, s, q])
                cw, cs, cq, cd = _columns(b, k, ("c_w", "c_s", "c_q", "c_d"))
                cost, at = best_splits(target, np.stack([_places(b.column(5)[k].as_py(), len(cw)), cw, cs, cq, cd]))
                better = cost < best
                best, place = np.where(better, cost, best), np.where(better, at, place)
        if now is not None:
            yield out()

    better = sorted_.mapInArrow(run, f"{ROWS}, at array<double>")
    # Blocks with no split yet, since too few values come before: nothing can end there.
    none = F.transform("w", lambda _: F.lit(float("inf")))
    rest = cand.join(better.select("b"), "b", "left_anti").select("b", "start", "w", "s", "q", none.alias("d"), F.transform("w", lambda _: F.lit(-1.0)).alias("at"))
    return stage(better.unionByName(rest), "break-level")


def natural_breaks(data: DataFrame, k: int, column: str = "v", times: str | None = None) -> list[float]:
    """Upper ends of ``k`` classes of a numeric column that minimise the squared deviation within classes, exactly: Fisher's division of the
    sorted distinct values by their counts. Nulls must be gone, and ``k`` no more than the distinct values. ``times``, if
    named, says how often a row counts.

    Values are counted, sorted by range and kept as blocks of running sums. Each further class is one level: first the best splits of
    the blocks' ends, then, block by block, of all values, among the splits between those of the ends around, since best splits never
    go back. Only ends of blocks, at most MOST_BLOCKS or twice that, are on the driver; no group holds all values.
    """
    first, ends, middle = _blocks(data, column, times)
    levels = [first]
    for _ in range(k - 1):
        levels.append(_next_level(levels[-1], ends))
    out, place = [], int(ends[-1, 1])
    for level in reversed(levels):
        b = int(np.searchsorted(ends[:, 1], place))
        at = F.lit(place) - F.col("start")
        slope = lambda c: F.element_at(c, at.cast("int"))
        before = lambda c: F.when(at > 1, F.element_at(c, F.greatest(at - 1, F.lit(1)).cast("int"))).otherwise(0.0 if b == 0 else float(ends[b - 1, {"w": 2, "s": 3}[c]]))
        split = slope("at") if "at" in level.columns else F.lit(-1.0)
        row = level.where(F.col("b") == b).select(((slope("s") - before("s")) / (slope("w") - before("w"))).alias("x"), split.alias("split")).first()
        out.append(row.x + middle)
        place = int(row.split)
    discard(*levels)
    # Sums gave the values but for rounding.
    near = data.agg(*(F.min_by(column, F.abs(F.col(column) - e)).alias(f"e{i}") for i, e in enumerate(out))).first()
    return sorted(near)
