"""Spelling variants: near words against all pairs, words against explicit runs, roots along chains."""

import random
import re
import zlib
from collections import Counter

import pytest

from terrafold.llm.common import stage
from terrafold.llm.spelling import corpus_words, group_variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def grouped(words, ratio=10):
    out = {}
    for w, n in words.items():
        near = [(-words[x], x.encode(), x) for x in words if x != w and one_edit(w, x)]
        best = min(near)[2] if near else None
        out[w] = (best if best and words[best] >= ratio * n else None, len(near))

    def root(w):
        return root(out[w][0]) if out[w][0] else w

    return sorted((w, f, root(w), words[w], k, words[f] if f else None) for w, (f, k) in out.items())


@pytest.mark.parametrize("seed,letters,n", [(0, "ab", 200), (1, "abcé", 500), (2, "aaab", 150), (3, "abcdefgÿ", 400)])
def test_all_pairs(spark, seed, letters, n):
    rnd = random.Random(seed)
    words = {"".join(rnd.choice(letters) for _ in range(rnd.randint(1, 9))): 10 ** rnd.randint(0, 6) * rnd.randint(1, 3) for _ in range(n)}
    words |= {"a": 5, "aa": 50, "aaa": 500, "aaaa": 5, "b": 1}
    got = group_variants(stage(spark.createDataFrame(list(words.items()), "word string, n long").repartition(4), "words-test"))
    assert sorted(map(tuple, got.collect())) == grouped(words)


def test_chain_of_forms(spark):
    """Ten steps of one edit, each ten times as frequent."""
    chain = [("abcdefghijklmn"[:k] + "zyxwvutsrqponm"[k:], 2 * 10**k) for k in range(11)]
    got = {r.word: r for r in group_variants(spark.createDataFrame(chain, "word string, n long")).collect()}
    assert all(r.root == chain[-1][0] for r in got.values()) and got[chain[0][0]].form == chain[1][0]


def test_ties_and_nothing(spark):
    words = {"wordb": 30, "worda": 30, "wordé": 3, "alone": 1}
    rows = spark.createDataFrame(list(words.items()), "word string, n long")
    assert sorted(map(tuple, group_variants(rows).collect())) == grouped(words)
    assert group_variants(rows.limit(0)).count() == 0


def test_words_of_odd_texts(spark):
    texts = [(1, "Éclairage ÉCLAIRAGE straße×÷ Internationalization's under_score abcdefg"), (2, None), (None, "abcdefg ABCDEFGH abcdefgh"), (3, ""), (3, "abcdefg " * 50_000), (3, "abcdefg"), (3, "abcdefg"), (4, "short words only, x" + "y" * 100_000)]
    texts += [(i, "longenoughword another verylongwordindeed") for i in range(400)]
    want = Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            want[run] += len(run) >= 7
    rows = stage(spark.createDataFrame([(i, t, "x", 7) for i, t in texts], "doc_id long, text string, word string, n int").repartition(3), "odd-words")
    assert {r.word: r.n for r in corpus_words(rows).collect()} == {w: n for w, n in want.items() if n >= 2}
    assert corpus_words(rows.limit(0)).count() == 0
