"""Near copies against brute force, on pairs that differ in one block."""

import pickle
import random
import weakref

import numpy as np
import pyarrow as pa
import pytest

from terrafold.llm import common, decontam, simhash
from terrafold.llm.common import stage


def shingles(text):
    words = text.lower().split()
    k = min(simhash.COPY_SHINGLE, len(words))
    return {" ".join(words[i : i + k]) for i in range(len(words) - k + 1)}


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


@pytest.fixture(scope="module")
def pairs():
    """(text, edited text) at similarities around 0.80 to 0.90: a block removed, added or replaced."""
    draw, out = random.Random(7), []
    fresh = lambda n: [f"w{draw.randrange(10**9)}" for _ in range(n)]
    for k in range(240):
        n, share = draw.randrange(120, 400), draw.uniform(0.09, 0.21)
        words, at, block = fresh(n), draw.randrange(0, n // 2), int(n * share)
        edited = [words[:at] + words[at + block :], words[:at] + fresh(block) + words[at:], words[:at] + fresh(block // 2) + words[at + block // 2 :]][k % 3]
        out.append((" ".join(words), " ".join(edited)))
    return out


def test_block_edits_lose_no_link(spark, pairs):
    docs = [(2 * k + i, t) for k, p in enumerate(pairs) for i, t in enumerate(p)]
    want = {2 * k for k in range(len(pairs))} | {2 * k + 1 for k, p in enumerate(pairs) if similarity(*p) < simhash.COPY_SIMILARITY}
    assert 150 <= 2 * len(pairs) - len(want) < len(pairs)
    kept = simhash.drop_near_copies(stage(spark.createDataFrame(docs, "doc_id long, text string"), "pairs"))
    assert {r.doc_id for r in kept.collect()} == want


def test_common_passage_and_large_group(spark):
    """A passage in every text, and a group of many edits of one text: the order of shingles changes no result."""
    draw = random.Random(8)
    fresh = lambda n: [f"w{draw.randrange(10**9)}" for _ in range(n)]
    passage, base = fresh(60), fresh(200)
    texts = [" ".join(passage + fresh(draw.randrange(8, 40))) for _ in range(60)]
    texts += [" ".join(base[:i] + fresh(3) + base[i + 3 :]) for i in range(0, 190, 3)]
    group = list(range(len(texts)))
    for a in group:
        for b in group[:a]:
            if similarity(texts[a], texts[b]) >= simhash.COPY_SIMILARITY:
                top, low = max(group[a], group[b]), min(group[a], group[b])
                group = [low if g == top else g for g in group]
    kept = simhash.drop_near_copies(stage(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "passage"))
    assert {r.doc_id for r in kept.collect()} == set(group)


def test_signatures_find_every_near_print(spark, monkeypatch):
    """The named method takes part: all prints within COPY_BITS of each other, by deletion variants, and equal prints by their least class."""
    draw = random.Random(9)
    prints = [draw.getrandbits(63) for _ in range(40)]
    prints += [p ^ sum(1 << b for b in draw.sample(range(63), k % 6)) for k, p in enumerate(prints)]
    classes = list(enumerate(prints))
    want = {(a, b) for a, p in classes for b, q in classes if a < b and (p ^ q).bit_count() <= simhash.COPY_BITS}
    least = {p: min(i for i, q in classes if q == p) for p in prints}
    want = {(a, b) for a, b in want if least[prints[a]] == a and (least[prints[b]] == b or prints[a] == prints[b])}
    got = simhash._signature_pairs(stage(spark.createDataFrame(classes, "id long, fp long"), "classes")).collect()
    assert len(got) == len(want) and {(r.u, r.v) for r in got} == want

    asked, search = [], simhash.hamming_links
    monkeypatch.setattr(simhash, "hamming_links", lambda *a: (asked.append(a[1]), search(*a))[1])
    assert simhash.drop_near_copies(stage(spark.createDataFrame([(1, "a b"), (2, "A b")], "doc_id long, text string"), "two")).count() == 1
    assert asked == [simhash.COPY_BITS]


def test_a_sieve_lets_all_its_keys_through_and_stays_off_the_driver(spark):
    draw = random.Random(10)
    keys = [draw.getrandbits(64) for _ in range(100_000)]
    made = common.sieve(stage(spark.createDataFrame([(k - (1 << 64) if k >> 63 else k,) for k in keys], "k long"), "keys"), "k")
    bits = common.bitmap(made)
    assert len(made[2]) > 1 and len(pickle.dumps(made)) < 1000
    assert common.passes(bits, np.array(keys, np.uint64)).all()
    assert common.passes(bits, np.arange(0, 1 << 40, 1 << 20, dtype=np.uint64) + np.uint64(12345)).mean() < 0.05
    none = common.sieve(spark.createDataFrame([], "k long"), "k")
    assert not common.passes(common.bitmap(none), np.array(keys, np.uint64)).any()


def test_no_job_of_near_copies_plans_many_joins(spark, monkeypatch):
    """The driver plans, compiles and runs all stages of one job at once; that of all star pairs was the largest."""
    joins, write = [], simhash.stage
    monkeypatch.setattr(simhash, "stage", lambda df, tag: (joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join ")), write(df, tag))[1])
    assert simhash.drop_near_copies(stage(spark.createDataFrame([(1, "a b"), (2, "A b")], "doc_id long, text string"), "two")).count() == 1
    assert 0 < max(joins) <= 6


def test_workers_keep_no_bitmap_and_get_small_batches(spark):
    """Python workers live on through all stages: what one step left in them, every later step paid for."""
    made = common.sieve(spark.createDataFrame([(k,) for k in range(1000)], "k long"), "k")
    held = weakref.ref(common.bitmap(made))
    assert held() is None

    texts = spark.createDataFrame([(f"{k} " * 4000,) for k in range(1000)], "text string").coalesce(1)
    sizes = lambda: [r.n for r in texts.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches), "n long").collect()]
    with common.small_batches(spark):
        small = sizes()
    assert len(small) > 1 and max(small) < 2 * common.PART_BYTES < sum(small)
    assert max(sizes()) > 2 * common.PART_BYTES


def test_leaks_are_dropped_part_by_part(spark):
    """A batch of long texts is searched, and given back, in parts of a bounded size; no row is lost or moved."""
    draw = random.Random(11)
    passage = " ".join(f"w{draw.randrange(10**9)}" for _ in range(40))
    texts = [" ".join(f"w{draw.randrange(10**9)}" for _ in range(400)) + (f" {passage}" if k % 7 == 0 else "") for k in range(3000)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])

    class Docs:
        columns, schema, sparkSession = batch.schema.names, None, spark

        def mapInArrow(self, function, schema):
            return list(function(iter([batch, batch.slice(0, 0)])))

    out = decontam.drop_leaks(Docs(), spark.createDataFrame([(1, passage)], "item_id long, text string"))
    assert [i for b in out for i in b.column(0).to_pylist()] == [k for k in range(len(texts)) if k % 7 or k >= 3000]
    assert batch.nbytes > 4 * common.PART_BYTES and max(b.nbytes for b in out) < 2 * common.PART_BYTES
