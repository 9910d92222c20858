"""Fuzzy names: every pair at or over the floor is found, by brute force; hot letters included."""

import random

import pytest
from pyspark.sql import functions as F

from terrafold.operators import matching as mt


def best(a, b):
    return max(mt.indel_ratio(a, b), mt.indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))))


@pytest.mark.parametrize("floor", [82.0, 70.0])
def test_no_similar_pair_is_lost(spark, floor):
    rnd = random.Random(int(floor))
    word = lambda letters, n: "".join(rnd.choice(letters) for _ in range(n))
    units = [" ".join(word("abcde", rnd.randint(1, 5)) for _ in range(rnd.randint(1, 5))) for _ in range(120)] + ["ab cd ef", "aaaaaaaa", "aaaaaab", "x"]
    names = ["a b c d e f", "aaaaaaaaa", "xy", "x"]
    for u in units[:110]:
        chars = list(u)
        for _ in range(rnd.randint(1, 4)):
            k = rnd.randrange(len(chars) + 1)
            chars[k : k + rnd.randint(0, 1)] = rnd.choice(["", "z", " ", "a"])
        names.append("".join(chars))
        names.append(" ".join(reversed(u.split())))
    tidy = lambda x: " ".join(x.split())
    names, units = sorted({tidy(n) for n in names if tidy(n)}), sorted({tidy(u) for u in units})
    keys = lambda some, c: spark.createDataFrame([(x,) for x in some], f"{c} string")
    plain = mt._candidates(keys(names, "key").withColumn("a", F.col("key")), keys(units, "known").withColumn("b", F.col("known")), floor, [])
    got = {(r.key, r.known) for r in plain.collect()}
    want = {(a, b) for a in names for b in units if mt.indel_ratio(a, b) >= floor}
    assert want <= got and len(got) < len(names) * len(units) / 2
    index = mt.name_index(spark.createDataFrame(list(enumerate(units)), "shape_id int, name string"), "")
    found = {r.raw: (r.score, r.name) for r in mt.fuzzy_names(keys(names, "raw"), index, "", floor=floor).collect()}
    for a in names:
        score, first = max((best(a, b), -k) for k, b in enumerate(units))
        assert (found[a] == (pytest.approx(score), units[-first])) if score >= floor else a not in found


def test_blanks_inside_words_count(spark):
    index = mt.name_index(spark.createDataFrame([(1, "ab cd ef"), (2, "xyz")], "shape_id int, name string"), "")
    got = mt.fuzzy_names(spark.createDataFrame([("a b c d e f",), ("",), (None,)], "raw string"), index, "").collect()
    assert [(r.raw, r.name, round(r.score, 1)) for r in got] == [("a b c d e f", "ab cd ef", 84.2)]


def test_too_low_a_floor_is_refused(spark):
    index = mt.name_index(spark.createDataFrame([(1, "ab")], "shape_id int, name string"), "")
    with pytest.raises(ValueError):
        mt.fuzzy_names(spark.createDataFrame([("b",)], "raw string"), index, "", floor=60)
