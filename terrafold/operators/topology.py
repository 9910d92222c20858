"""Thinning of outlines that keeps the border between two shapes a single line."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import without_repeats
from ..staging import discard, shuffled_to, stage
from .levels import meeting

VERTEX = "struct<x:double,y:double>"
#: An arc that would cross something is thinned again with a tolerance so many times less, and after RETRIES of these not at all.
LESS, RETRIES = 4.0, 3
#: Vertices that one task of a shuffle takes, about, so that its memory doesn't grow with the coverage.
VERTICES_A_TASK = 250_000


def rings_of(shapes: DataFrame) -> DataFrame:
    """``(shape_id, part, ring, pts)``: a row for each ring with three vertices or more."""
    parts = shapes.select("shape_id", F.posexplode("geom").alias("part", "rings"))
    rings = parts.select("shape_id", "part", F.posexplode("rings").alias("ring", "pts"))
    return rings.withColumn("pts", without_repeats(F.col("pts"))).where("size(pts) >= 3")


def nodes(rings: DataFrame) -> DataFrame:
    """``(v)``: vertices with other than two distinct neighbours: where more than two borders meet, and tips of spikes."""
    n = F.size("pts")
    both = F.flatten(F.transform("pts", lambda p, i: F.array(*(F.struct(p.alias("v"), F.get("pts", (i + k) % n).alias("w")) for k in (F.lit(1), n - 1)))))
    return rings.select(F.explode(both).alias("e")).select("e.*").repartition("v").distinct().groupBy("v").agg(F.count("*").alias("n")).where("n <> 2").select("v")


def arcs_of(rings: DataFrame) -> DataFrame:
    """``rings`` to ``(shape_id, part, ring, k, arc, forward)``: the ring is its arcs in order, each from node to node. ``arc`` runs in the
    direction that compares as less, so that all owners have it alike; a ring without a node is one closed arc from its least vertex.

    Only vertices are shuffled to find the nodes, and only places of nodes come back to the rings.
    """
    key = ["shape_id", "part", "ring"]
    at = rings.select(*key, F.posexplode("pts").alias("i", "v")).join(nodes(rings), "v").groupBy(*key).agg(F.array_sort(F.collect_list("i")).alias("cuts"))
    n, pts = F.size("pts"), F.col("pts")
    least = F.array_position("pts", F.array_min("pts")).cast("int") - 1
    whole = rings.join(at, key, "left").withColumn("cuts", F.coalesce("cuts", F.array(least)))
    ends = F.transform("cuts", lambda c, k: F.struct(c.alias("a"), F.coalesce(F.get("cuts", k + 1), F.get("cuts", F.lit(0)) + n).alias("b")))
    cut = F.transform(ends, lambda e: F.slice(F.concat(pts, pts), e["a"] + 1, e["b"] - e["a"] + 1))
    out = whole.select(*key, F.posexplode(cut).alias("k", "one"))
    forward = F.col("one") <= F.reverse("one")
    return out.select(*key, "k", F.when(forward, F.col("one")).otherwise(F.reverse("one")).alias("arc"), forward.alias("forward"))


def thin(xy: np.ndarray, least: float) -> np.ndarray:
    """Places of the vertices of an arc that stay: the vertex whose triangle with its neighbours is smallest goes, while that is smaller
    than ``least``. Ends stay; a closed arc keeps three vertices. Ties: the first vertex."""
    n = len(xy)
    before, after = np.arange(-1, n - 1), np.arange(1, n + 1)
    x, y = xy[:, 0].tolist(), xy[:, 1].tolist()
    room = n - 2 - (2 if n > 2 and (xy[0] == xy[-1]).all() else 0)

    def area(k: int) -> float:
        a, b = before[k], after[k]
        return abs((x[k] - x[a]) * (y[b] - y[a]) - (x[b] - x[a]) * (y[k] - y[a])) / 2

    now = {k: area(k) for k in range(1, n - 1)}
    heap = [(s, k) for k, s in now.items()]
    heapq.heapify(heap)
    while heap and room > 0:
        s, k = heapq.heappop(heap)
        if s >= least:
            break
        if now.get(k) != s:
            continue
        del now[k]
        a, b = int(before[k]), int(after[k])
        after[a], before[b], room = b, a, room - 1
        for m in (a, b):
            if m in now:
                now[m] = max(area(m), s)  # what follows a removal is never judged less than it
                heapq.heappush(heap, (now[m], m))
    return np.array([0, *sorted(now), n - 1])


def _thinned(arcs: DataFrame, tolerance: float) -> DataFrame:
    """``arcs(head, arc, tries)``, with ``thin``. Arcs of a batch are cut out of its vertices, and thin ones taken from them, as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, kept, sizes = b.column(1), [], []
            vertices, at = lists.flatten(), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy()))).tolist()
            xy = np.stack([vertices.field(0).to_numpy(), vertices.field(1).to_numpy()], 1)
            for start, end, tries in zip(at, at[1:], b.column(2).to_pylist()):
                some = thin(xy[start:end], (tolerance / LESS**tries) ** 2 if tries < RETRIES else 0.0)
                kept.append(some + start)
                sizes.append(len(some))
            taken = vertices.take(pa.array(np.concatenate(kept) if kept else np.zeros(0, np.int64)))
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(offsets, taken)], ["head", "arc", "tries", "thin"])

    head = f"struct<a:{VERTEX},b:{VERTEX}>"
    return arcs.select("head", "arc", "tries").mapInArrow(run, f"head {head}, arc array<{VERTEX}>, tries int, thin array<{VERTEX}>")


def _pieces(arcs: DataFrame) -> DataFrame:
    """``arcs(head, arc, thin)`` to ``(head, piece)``: for each edge of the thin arc the vertices of the arc that it stands for, where it
    stands for more than itself. A vertex is met once in an arc, but for a closed one's ends."""
    n = F.size("thin")
    place = lambda p, i: F.when(i == n - 1, F.size("arc")).otherwise(F.array_position("arc", p).cast("int"))
    at = F.transform("thin", place)
    spans = F.transform(F.slice(at, 1, n - 1), lambda a, i: F.slice("arc", a, F.get(at, i + 1) - a + 1))
    return arcs.select("head", F.explode(F.filter(spans, lambda s: F.size(s) > 2)).alias("piece"))


def _inside(v: Column, ring: Column) -> Column:
    """If a vertex lies inside a closed line by the even-odd rule, or on the edge that closes it."""
    n = F.size(ring)
    a, b = F.element_at(ring, -1), F.element_at(ring, 1)
    turn = (b["x"] - a["x"]) * (v["y"] - a["y"]) - (b["y"] - a["y"]) * (v["x"] - a["x"])
    on = (turn == 0) & v["x"].between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & v["y"].between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))

    def crossed(p: Column, q: Column) -> Column:
        x = p["x"] + (v["y"] - p["y"]) * (q["x"] - p["x"]) / (q["y"] - p["y"])
        return ((p["y"] > v["y"]) != (q["y"] > v["y"])) & (v["x"] < x)

    count = F.size(F.filter(F.sequence(F.lit(0), n - 1), lambda i: crossed(F.get(ring, i), F.get(ring, (i + 1) % n))))
    return on | (count % 2 == 1)


def _broken(arcs: DataFrame, vertices: DataFrame) -> DataFrame:
    """``(head)`` of the thin arcs between which and the arc a foreign vertex of the coverage lies: what lay on one side would lie on the
    other. If there is none, no two thin edges cross."""
    axis = lambda k: F.transform("piece", lambda p: p[k])
    box = F.struct(*(f(axis(k)).alias(f"{k}{e}") for e, f in (("0", F.array_min), ("1", F.array_max)) for k in "xy"))
    pieces = stage(_pieces(arcs).withColumn("a_id", F.struct("head", F.element_at("piece", 1).alias("p"), F.element_at("piece", 2).alias("q"))).withColumn("a_box", box), "thin-pieces")
    points = vertices.select(F.col("v").alias("b_id"), F.struct(F.col("v.x").alias("x0"), F.col("v.y").alias("y0"), F.col("v.x").alias("x1"), F.col("v.y").alias("y1")).alias("b_box"))
    near = meeting(pieces.select("a_id", "a_box"), points).select("a_id", F.col("b_id").alias("v"))
    hit = near.join(pieces.select("a_id", "piece"), "a_id").where(~F.array_contains("piece", F.col("v")) & _inside(F.col("v"), F.col("piece")))
    out = stage(hit.select("a_id.head").distinct(), "broken-arcs")
    discard(pieces)
    return out


def _doubled(arcs: DataFrame) -> DataFrame:
    """``(head)`` of thin arcs that share an edge with another: a ring between them would be nothing."""
    n = F.size("thin")
    e = F.transform(F.slice("thin", 1, n - 1), lambda p, i: F.struct(F.least(p, F.get("thin", i + 1)).alias("a"), F.greatest(p, F.get("thin", i + 1)).alias("b")))
    edges = arcs.select("head", F.explode(e).alias("e"))
    more = edges.groupBy("e").agg(F.count("*").alias("n")).where("n > 1").select("e")
    return edges.join(more, "e").select("head").distinct()


def coverage_simplify(shapes: DataFrame, tolerance: float) -> DataFrame:
    """``shapes(shape_id, geom)``, ids distinct, with outlines thinned so that neighbours keep equal borders at every tolerance.

    Rings are cut into arcs where more than two borders meet; each arc, which all its owners spell alike, is thinned once: the vertex with
    the smallest triangle goes while that is below ``tolerance`` squared, ends are held. An arc is thinned less, in the end not at all,
    where a foreign vertex would change sides or two arcs would become one edge; so no line crosses another that did not before, no
    ring vanishes, and a hole stays where it is. Shapes that do not meet exactly share no arc and are thinned one by one. Rings of
    under three vertices go; a shape without any keeps an empty geometry. Null geometry and empty input: as they are.

    Vertices, node places and arcs are shuffled, each by its own key; an arc is a row, so the longest border bounds a task's row.
    """
    rings = stage(rings_of(shapes), "rings")
    n = rings.agg(F.sum(F.size("pts"))).first()[0] or 0
    with shuffled_to(shapes.sparkSession, -(-n // VERTICES_A_TASK)):
        return _simplified(shapes, rings, tolerance)


def _simplified(shapes: DataFrame, rings: DataFrame, tolerance: float) -> DataFrame:
    """`coverage_simplify` of shapes whose ``rings`` are staged."""
    owned = stage(arcs_of(rings), "ring-arcs")
    # An edge belongs to one arc, so the arc's first one names it.
    head = F.struct(F.get("arc", F.lit(0)).alias("a"), F.get("arc", F.lit(1)).alias("b")).alias("head")
    arcs = stage(owned.select(head, "arc").groupBy("head").agg(F.first("arc").alias("arc")), "arcs")
    vertices = stage(arcs.select(F.explode("arc").alias("v")).distinct(), "arc-vertices")
    done: list[DataFrame] = []
    left = arcs.withColumn("tries", F.lit(0))
    while True:
        tried = stage(_thinned(left, tolerance), "thin-arcs")
        bad = _broken(tried, vertices)
        good = stage(tried.join(bad, "head", "left_anti").select("head", "tries", "thin"), "good-arcs")
        again = tried.join(bad, "head").select("head", "arc", (F.col("tries") + 1).alias("tries"))
        done.append(good)
        left = stage(again, "arcs-again")
        discard(tried, bad)
        if left.isEmpty():
            break
    # Arcs as they came share no edge, so those that do step back together until none is left.
    thinned = stage(done[0] if len(done) == 1 else _union(done), "thinned")
    while not (twice := stage(_doubled(thinned).join(thinned.where(F.col("tries") <= RETRIES).select("head", "tries"), "head"), "doubled-arcs")).isEmpty():
        left = arcs.join(twice, "head").withColumn("tries", F.col("tries") + 1)
        tried = stage(_thinned(left, tolerance), "thin-arcs")
        bad = _broken(tried, vertices)
        back = tried.join(bad.withColumn("bad", F.lit(True)), "head", "left")
        plain = F.col("bad") | (F.col("tries") >= RETRIES)
        back = back.select("head", F.when(plain, F.lit(RETRIES + 1)).otherwise(F.col("tries")).alias("tries"), F.when(plain, F.col("arc")).otherwise(F.col("thin")).alias("thin"))
        thinned = stage(thinned.join(twice, "head", "left_anti").unionByName(back), "thinned")
    named = owned.select("shape_id", "part", "ring", "k", "forward", head)
    line = F.when(F.col("forward"), F.col("thin")).otherwise(F.reverse("thin"))
    pieces = named.join(thinned, "head").select("shape_id", "part", "ring", F.struct("k", F.slice(line, 1, F.size("thin") - 1).alias("pts")).alias("one"))
    joined = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(c)), lambda o: o["pts"]))
    in_order = lambda name: F.transform(F.array_sort(F.collect_list(F.struct(F.col(name).alias("k"), "pts"))), lambda o: o["pts"]).alias("pts")
    back = pieces.groupBy("shape_id", "part", "ring").agg(joined("one").alias("pts"))
    back = back.groupBy("shape_id", "part").agg(in_order("ring")).groupBy("shape_id").agg(in_order("part"))
    free = max((c for c in shapes.columns), key=len) + "_"
    out = shapes.join(back.withColumnRenamed("pts", free), "shape_id", "left")
    empty = F.when(F.col("geom").isNotNull(), F.slice("geom", 1, 0))
    return stage(out.withColumn("geom", F.coalesce(free, empty)).drop(free), "simplified")


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out
