"""Vector codes against explicit rounds, trees against every entry, odd vectors."""

import math

import numpy as np
import pytest

from terrafold.llm.common import stage
from terrafold.llm.vector_codes import compress, digest, nearest, plant, squared

SCHEMA = "vec_id long, embedding array<float>, label int, code string, q int"


@pytest.mark.parametrize("seed", range(6))
def test_trees_find_the_first_nearest(seed):
    rnd = np.random.default_rng(seed)
    most = (3, 1000, 1 << 24)[seed % 3]
    book = rnd.integers(-most, most + 1, (256, (1, 2, 16)[seed % 3]))
    book[100:140] = book[7]  # equal entries: the first counts
    points = np.concatenate([rnd.integers(-most, most + 1, (500, book.shape[1])), book])
    index, best = nearest(points, book, plant(book))
    d = np.stack([((points - e) ** 2).sum(1) for e in book], 1)
    assert (best == d.min(1)).all() and (index == d.argmin(1)).all()
    assert (squared(points, book) == d).all()


def rounds(rows):
    """The whole method over (id, vector), kept rows only, by plain integers."""
    whole = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows]
    size = len(whole[0][1]) // 4
    part = lambda q, p: q[size * p : size * (p + 1)]
    first = sorted(whole, key=lambda r: (r[0] is None, r[0], r[1]))[:256]
    books = [[part(q, p) for _, q in first] for p in range(4)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda q, p: min((far(part(q, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(4):
        nxt = []
        for p in range(4):
            groups = {}
            for _, q in whole:
                groups.setdefault(near(q, p)[1], []).append(part(q, p))
            nxt.append([[sum(c) // len(c) for c in zip(*groups[k])] if k in groups else e for k, e in enumerate(books[p])])
        books = nxt
    return books, [(i, "".join(f"{near(q, p)[1]:02x}" for p in range(4)), sum(near(q, p)[0] for p in range(4))) for i, q in whole]


def test_rounds_with_odd_vectors(spark):
    rnd = np.random.default_rng(1)
    good = [(i, rnd.normal(size=8).astype(np.float32).tolist()) for i in range(330)]
    good += [(400, good[0][1]), (400, good[0][1]), (None, good[5][1]), (401, [0.0] * 8), (402, [-0.0] * 8), (403, [-1e-9] * 8)]
    bad = [(500, None), (501, [None] + [1.0] * 7), (502, [math.nan] + [1.0] * 7), (503, [math.inf] + [1.0] * 7), (504, [-math.inf] * 8)]
    short = [(-1, []), (600, [1.0, 2.0])]
    label = lambda i: None if i is None or i % 3 == 0 else i % 3
    rows = stage(spark.createDataFrame([(i, v, label(i), "x", 1) for i, v in [*good, *bad, *short]], SCHEMA).repartition(5), "odd-vectors")
    coded, books = compress(rows)
    got = coded.collect()
    want_books, want = rounds(good)
    assert [b.tolist() for b in books] == want_books and digest(books) == digest([np.array(b) for b in want_books])
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted([(r.vec_id, r.code, r.error) for r in got if r.code], key=key) == sorted(want, key=key)
    assert {r.vec_id for r in got if r.code is None} == {-1, 600}
    for x in (None, 1, 2):
        total = sum(e for i, _, e in want if label(i) == x)
        assert {r.label_error for r in got if r.label == x} == {total}


def test_few_and_no_vectors(spark):
    rows = spark.createDataFrame([(2, [1.0] * 4, None, "", 0), (1, [0.5] * 4, 3, "", 0), (1, [0.5] * 4, 3, "", 0)], SCHEMA)
    coded, books = compress(rows)
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in coded.collect()) == [(1, "00000000", 0, 0), (1, "00000000", 0, 0), (2, "02020202", 0, 0)]
    assert [len(b) for b in books] == [3] * 4
    coded, books = compress(rows.limit(0))
    assert coded.count() == 0 and books == []


def test_too_large_components(spark):
    with pytest.raises(Exception, match="too large"):
        compress(spark.createDataFrame([(1, [1e30] * 4, 1, "", 0)], SCHEMA))[0].collect()
