"""Borders stay shared when outlines are thinned; clipping keeps areas; boxes of all sizes meet; land masses by brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.functions.clipping import clip_at
from terrafold.functions.geometry import GEOMETRY, area
from terrafold.operators import geo, topology
from terrafold.operators.levels import meeting
from terrafold.operators.topology import coverage_simplify, thin
from terrafold.queries.geography import blocks, jagged
from tests.support import SF

SCHEMA = f"shape_id long, geom {GEOMETRY}, pts int"


def ring(points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def jagged_border(a, b):
    lo, hi = min(a, b), max(a, b)
    rnd, pts = random.Random(str((lo, hi))), [lo]
    for k in range(1, 9):
        t, d = k / 9, (rnd.random() - 0.5) * 0.15
        flat = hi[0] == lo[0]
        pts.append((lo[0] + (hi[0] - lo[0]) * t + d * flat, lo[1] + (hi[1] - lo[1]) * t + d * (not flat)))
    return [*pts, hi] if (a, b) == (lo, hi) else [hi, *reversed(pts)]


@pytest.fixture(scope="module")
def coverage(spark):
    """Nine cells with jagged borders, a round enclave in one, an island elsewhere, an empty and a null shape."""
    rows = []
    for i in range(3):
        for j in range(3):
            c = [(float(i), float(j)), (i + 1.0, float(j)), (i + 1.0, j + 1.0), (float(i), j + 1.0)]
            rows.append([3 * i + j, [[ring([p for a, b in zip(c, c[1:] + c[:1]) for p in jagged_border(a, b)[:-1]])]], 0])
    round_ = [(0.5 + 0.2 * math.cos(k * math.pi / 10), 0.5 + 0.2 * math.sin(k * math.pi / 10)) for k in range(20)]
    rows[0][1][0].append(ring(round_[::-1]))
    rows += [[100, [[ring(round_)], [ring([(9, 9), (9.1, 9.4), (9.2, 9.1), (9.2, 9.1)])]], 0], [101, [], 0], [102, None, 0]]
    return spark.createDataFrame([tuple(r) for r in rows], SCHEMA)


def crossings(rows):
    """Pairs of edges of the whole coverage that cross properly."""
    rings = [[(v.x, v.y) for v in g] for r in rows for p in r.geom or [] for g in p]
    es = {frozenset(e) for t in rings for e in zip(t, t[1:] + t[:1])}
    es = [tuple(e) for e in es if len(e) == 2]
    turn = lambda a, b, c: np.sign((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))
    return [(e, f) for k, e in enumerate(es) for f in es[:k] if not set(e) & set(f) and turn(*e, f[0]) * turn(*e, f[1]) < 0 and turn(*f, e[0]) * turn(*f, e[1]) < 0]


@pytest.mark.parametrize("tolerance", [0.03, 0.4, 10.0])
def test_borders_stay_shared(coverage, tolerance):
    out = coverage_simplify(coverage, tolerance)
    assert out.columns == coverage.columns
    rows = out.collect()
    count = lambda rs: sum(len(g) for r in rs for p in r.geom or [] for g in p)
    assert count(rows) < count(coverage.collect())
    assert not crossings(rows)
    assert [r.geom for r in rows if r.shape_id in (101, 102)] in ([[], None], [None, []])
    sizes = {r.shape_id: r.a for r in out.select("shape_id", area(F.col("geom")).alias("a")).collect()}
    assert all(sizes[k] > 0 for k in [*range(9), 100])
    # The cells and the enclave in one of them tile what the outline of all holds, so no border came apart.
    border = [e for e in geo.outline(out.where("shape_id < 101")).collect() if e.x0 < 8]
    inside = sum(sizes[k] for k in range(9)) + sum(area_of(p[0]) for r in rows if r.shape_id == 100 for p in r.geom if p[0][0].x < 8)
    assert inside == pytest.approx(shoelace(border))
    assert all(not (0.3 < e.x0 < 2.7 and 0.3 < e.y0 < 2.7) for e in border)


def area_of(vertices):
    return abs(sum(a.x * b.y - b.x * a.y for a, b in zip(vertices, vertices[1:] + vertices[:1]))) / 2


def shoelace(border):
    """Area in a closed line given as edges in any order."""
    ends = {}
    for e in border:
        ends.setdefault((e.x0, e.y0), []).append((e.x1, e.y1))
        ends.setdefault((e.x1, e.y1), []).append((e.x0, e.y0))
    start = at = next(iter(ends))
    path, last = [at], None
    while True:
        last, at = at, next(p for p in ends[at] if p != last)
        if at == start:
            break
        path.append(at)
    assert len(path) == len(border)
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(path, path[1:] + path[:1]))) / 2


def test_a_vertex_between_line_and_chord_stays_on_its_side(spark):
    """The tip of the right shape reaches into the bay of the left one, further than the bay's chord."""
    left = ring([(0, 0), (4, 0), (4, 1), (2, 1.5), (4, 2), (4, 3), (0, 3)])
    right = ring([(2.5, 1.5), (6, 1.4), (6, 1.6)])
    rows = coverage_simplify(spark.createDataFrame([(1, [[left]], 0), (2, [[right]], 0)], SCHEMA), 1.3).collect()
    tip = {r.shape_id: [(v.x, v.y) for v in r.geom[0][0]] for r in rows}
    assert (2.0, 1.5) in tip[1] and not crossings(rows)


def test_thinning_takes_the_smallest_triangle_first():
    xy = np.array([(0, 0), (1, 0.1), (2, 1), (3, 0.1), (4, 0)], float)
    assert thin(xy, 0.2).tolist() == [0, 1, 2, 3, 4] and thin(xy, 0.41).tolist() == [0, 2, 4] and thin(xy, 99).tolist() == [0, 4]
    assert thin(xy, 0.0).tolist() == [0, 1, 2, 3, 4]
    square = np.array([(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)], float)
    assert len(thin(square, 99)) == 4


def test_no_shapes(coverage):
    assert coverage_simplify(coverage.limit(0), 1.0).count() == 0


@pytest.mark.parametrize("meridian", [2.0, 2.5, 9.0])
def test_clipping_keeps_areas(spark, meridian):
    rnd = random.Random(7)

    def star(n, low, high, turn=1):
        return [(2 + r * math.cos(turn * 2 * math.pi * k / n), r * math.sin(turn * 2 * math.pi * k / n)) for k in range(n) for r in [rnd.uniform(low, high)]]

    shapes = [
        [[ring([(0, 0), (4, 0), (4, 1), (2, 1), (2, 2), (4, 2), (4, 3), (0, 3)])]],
        [[ring([(0, 0), (4, 0), (4, 4), (0, 4)]), ring([(1, 1), (1, 3), (3, 3), (3, 1)])]],
        [[ring([(2, 0), (3, 1), (2, 2), (3, 3), (2, 4), (1, 2)])]],
        [],
        None,
        *([[ring(star(rnd.randint(5, 60), 1, 3, rnd.choice([1, -1]))), ring(star(12, 0.2, 0.8, rnd.choice([1, -1])))], [ring([(8, 8), (9, 8), (9, 9)])]] for _ in range(40)),
    ]
    df = spark.createDataFrame([(k, s, 0) for k, s in enumerate(shapes)], SCHEMA)
    for r in geo.split_at(df, meridian).select("*", area(F.col("geom")).alias("a"), area(F.col("west")).alias("w"), area(F.col("east")).alias("e")).collect():
        if r.geom is None:
            assert r.west is None and r.east is None
            continue
        assert r.w + r.e == pytest.approx(r.a, abs=1e-9)
        assert all(v.x <= meridian + 1e-9 for p in r.west for g in p for v in g) and all(v.x >= meridian - 1e-9 for p in r.east for g in p for v in g)
        if meridian == 2.5 and r.shape_id == 0:
            assert (len(r.west), len(r.east)) == (1, 2)


def test_drawing_is_clipped_only_with_an_inset(spark):
    df = spark.createDataFrame([(1, [[ring([(0, 0), (4, 0), (4, 1), (0, 1)])]], 0), (2, [[ring([(9, 0), (10, 0), (10, 1), (9, 1)])]], 0)], SCHEMA)
    for meridian, drawn in ((3.0, [3.0, 0.0]), (None, [4.0, 1.0]), (20.0, [4.0, 1.0])):
        out = geo.clip_for_drawing(df, geo.inset_view(df, meridian), meridian).select("shape_id", area(F.col("drawn")).alias("d"), area(F.col("geom")).alias("g")).collect()
        assert [r.shape_id for r in out] == [1, 2] and [r.d for r in out] == pytest.approx(drawn) and [r.g for r in out] == pytest.approx([4.0, 1.0])


def test_boxes_of_all_sizes_meet_once(spark):
    rnd = random.Random(2)
    boxes = []
    for k in range(300):
        x, y, w = rnd.uniform(-50, 50), rnd.uniform(-50, 50), rnd.choice([0, 0.01, 0.3, 5, 60])
        boxes.append((k, (x, y, x + w, y + w * rnd.random())))
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    a, b = (spark.createDataFrame(boxes, f"{s}_id long, {s}_box {box}") for s in "ab")
    got = sorted((r.a_id, r.b_id) for r in meeting(a, b).collect())
    assert got == sorted((i, j) for i, p in boxes for j, q in boxes if p[0] <= q[2] and q[0] <= p[2] and p[1] <= q[3] and q[1] <= p[3])


def test_land_masses_by_brute_force(spark):
    """A long mainland, islets near and far, a lake's island and two shapes of which one holds the other."""
    rnd = random.Random(11)
    coast = [(x / 4, 3 + rnd.random() / 5) for x in range(400)]
    shapes = [(0, [[ring([(0, 0), (100, 0), *reversed(coast)])]])]
    for k in range(1, 60):
        x, y, s = rnd.uniform(0, 100), rnd.uniform(-3, 9), rnd.choice([0.05, 0.3, 1.0])
        shapes.append((k, [[ring([(x, y), (x + s, y), (x + s / 2, y + s)])]]))
    shapes.append((99, [[ring([(50, 1), (50.01, 1), (50, 1.01)])]]))
    within = 0.4
    got = sorted((r.mass, r.n_parts) for r in geo.land_masses(spark.createDataFrame([(*s, 0) for s in shapes], SCHEMA), within).collect())
    lines = {k: [(v["x"], v["y"]) for v in g[0][0]] for k, g in shapes}

    def apart(p, a, b):
        t = max(0, min(1, ((p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1])) / ((b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2)))
        return math.hypot(p[0] - a[0] - t * (b[0] - a[0]), p[1] - a[1] - t * (b[1] - a[1]))

    def inside(p, line):
        return sum((a[1] > p[1]) != (b[1] > p[1]) and p[0] < a[0] + (p[1] - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for a, b in zip(line, line[1:] + line[:1])) % 2

    def near(p, q):
        some = any(apart(v, a, b) <= within for x, y in ((p, q), (q, p)) for v in x for a, b in zip(y, y[1:] + y[:1]))
        return some or inside(p[0], q) or inside(q[0], p)

    root = {k: k for k in lines}
    changed = True
    while changed:
        changed = False
        for i in lines:
            for j in lines:
                if root[i] < root[j] and near(lines[i], lines[j]):
                    root[j], changed = root[i], True
    groups = {}
    for k, r in root.items():
        groups.setdefault(r, []).append(k)
    assert got == sorted((f"{min(g)}:0", len(g)) for g in groups.values())


def test_clipping_works_out_each_step_once(spark):
    """Copies of an expression within copies multiply: they were 190 functions of one clipped shape."""
    df = spark.createDataFrame([(1, [[[(0.0, 0.0), (2.0, 0.0), (2.0, 2.0)]]])], f"shape_id int, geom {GEOMETRY}")
    steps = df.select(clip_at(F.col("geom"), 1.0, True).alias("west"))._jdf.queryExecution().analyzed().toString().count("lambdafunction(")
    assert steps < 100


def test_small_files_are_dealt_to_all_cores(spark):
    load = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    for shapes in (blocks(load), jagged(load)):
        assert shapes.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_tasks_of_thinning_stay_of_one_size(spark, coverage, monkeypatch):
    """More vertices mean more partitions, not larger ones; the session's own number comes back."""
    want, seen, write = coverage_simplify(coverage, 0.4).orderBy("shape_id").collect(), [], topology.stage
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    monkeypatch.setattr(topology, "VERTICES_A_TASK", 20)
    monkeypatch.setattr(topology, "stage", lambda df, tag: (seen.append((tag, int(spark.conf.get(key)))), write(df, tag))[1])
    assert coverage_simplify(coverage, 0.4).orderBy("shape_id").collect() == want
    assert spark.conf.get(key) == before and all(n > int(before) for tag, n in seen if tag != "rings")
    assert seen[-1][0] == "simplified"


def test_arcs_are_thinned_where_they_lie(spark):
    """Thin arcs come with their arcs, without a join of all arcs with themselves."""
    arcs = spark.createDataFrame([(((0.0, 0.0), (1.0, 0.1)), [(0.0, 0.0), (1.0, 0.1), (2.0, 1.0), (3.0, 0.1), (4.0, 0.0)], k) for k in (0, 3)], f"head struct<a:{topology.VERTEX},b:{topology.VERTEX}>, arc array<{topology.VERTEX}>, tries int")
    rows = topology._thinned(arcs, math.sqrt(0.41)).orderBy("tries").collect()
    assert [[v.x for v in r.thin] for r in rows] == [[0, 2, 4], [0, 1, 2, 3, 4]] and [len(r.arc) for r in rows] == [5, 5]
