"""Quality verdicts on texts that only one half of the method can tell, and against distances from explicit histograms."""

import math
import random
import unicodedata
from collections import Counter

import pytest

from terrafold.llm import quality
from terrafold.llm.common import stage


def prose(draw, common, letters, n):
    """``n`` words of which a third are common ones, in sentences."""
    words = [draw.choice(common) if draw.random() < 0.33 else "".join(draw.choices(letters, k=draw.randrange(3, 10))) for _ in range(n)]
    return ". ".join(" ".join(words[i : i + 12]).capitalize() for i in range(0, n, 12)) + "."


def verdicts(spark, rows):
    df = stage(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "texts")
    return {r.doc_id: r.kept for r in quality.quality_rules(df).collect()}


def test_texts_without_common_words_fail(spark):
    draw, letters = random.Random(3), "eeetttaaooinnshrrdlu"
    good = [(k, prose(draw, quality.COMMON_WORDS["en"], letters, draw.randrange(100, 400)), "en") for k in range(60)]
    salad = [(100 + n, prose(draw, ["keyword", "listing"], letters, n), "en") for n in (80, 150, 400, 2000)]
    got = verdicts(spark, good + salad)
    assert all(got[k] for k, *_ in good)
    assert not any(got[k] for k, *_ in salad)


def test_other_languages_are_judged_by_their_own_rows(spark):
    draw = random.Random(4)
    cyrillic, arabic = "оооеееааинтсрвлкмдпу", "اااللليييمنورتبعد"
    words = {"ru": "и в не на что с по как это но из у за от".split(), "ar": "في من على إلى أن عن مع هذا كان لا ما".split()}
    rows = [(k, prose(draw, quality.COMMON_WORDS["en"], "eeetttaaooinnshrrdlu", 150), "en") for k in range(40)]
    rows += [(100 + k, prose(draw, words["ru"], cyrillic, draw.randrange(100, 300)), "ru") for k in range(40)]
    rows += [(200 + k, prose(draw, words["ar"], arabic, draw.randrange(100, 300)), "ar") for k in range(40)]
    junk = [(300, " ".join("#$%|<>" * 3 for _ in range(30)) + " " + " ".join(f"{i}{i}" for i in range(200)), "ru"), (301, prose(draw, ["слово"], cyrillic, 400).lower(), "ru")]
    got = verdicts(spark, rows + junk + [(302, "", "ru"), (303, None, "ar"), (304, "no reference", "xx")])
    assert all(got[k] for k, *_ in rows)
    assert not any(got[k] for k in (302, 303, 304))
    assert not got[300] and not got[301]


def slow_chars(text):
    """Counts of the character classes of the words, joined by blanks, words with a digit as one digit."""
    kinds, out = {"Ll": "lower", "Lu": "upper", "Nd": "digit"}, Counter()
    words = ["0" if any(unicodedata.category(c) == "Nd" for c in w) else w for w in (x.decode() for x in text.encode().split())]
    for c in " ".join(words):
        kind = unicodedata.category(c)
        name = kinds.get(kind) or ("blank" if c == " " else "stop" if c in ".,;:?'\"()-" else "symbol" if c in "#*$%&|<>" else "mark" if c in "!_=+~^@/\\{}[]" else "letter" if kind[0] in "LM" else "other")
        out[name] += 1
    return [out[n] for n in ("lower", "blank", "upper", "digit", "stop", "symbol", "mark", "letter", "other")]


def slow_js(p, q):
    term = lambda a, b: a * math.log2(2 * a / (a + b)) if a else 0.0
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    return math.sqrt(max(0.0, sum(term(a, b) + term(b, a) for a, b in zip(p, q)) / 2))


def test_distances_brute_force(spark):
    """Every row's verdict and distances, from its own histograms and those of the rows that shape its language's reference."""
    from tests.support import SF

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    got = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    words = {i: [w.decode() for w in (r.text or "").encode().split()] for i, r in rows.items()}
    chars = {i: slow_chars(r.text or "") for i, r in rows.items()}
    passing = [i for i in rows if not got[i].base_failed]

    def reference(ids):
        out = {}
        for lang, common in quality.COMMON_WORDS.items():
            own = [i for i in ids if rows[i].lang == lang]
            if own:
                counts = Counter(w for i in own for w in words[i])
                hits = [counts[w] for w in common]
                out[lang] = [sum(x) for x in zip(*(chars[i] for i in own))], [*hits, sum(counts.values()) - sum(hits)]
        return out

    def every(i, references):
        """(excess, distances, distance without common words) by each language."""
        if rows[i].lang is not None and rows[i].lang not in references:
            return [(0.0, 0.0, 0.0, 0.0)]
        few, fits = 1 / math.sqrt(max(len(words[i]), 1)), []
        for lang, (of_chars, of_words) in references.items():
            mine = Counter(words[i])
            hits = [mine[w] for w in quality.COMMON_WORDS[lang]]
            c = slow_js(chars[i], of_chars) if sum(chars[i]) >= quality.MIN_CHARS else 0.0
            w = slow_js([*hits, len(words[i]) - sum(hits)], of_words) if len(words[i]) >= quality.MIN_WORDS else 0.0
            none = slow_js([0] * len(hits) + [1], of_words)
            limit = min(quality.WORD_LIMIT + quality.WORD_NOISE * few, none * min(quality.NONE_SHARE + quality.NONE_NOISE * few, quality.NONE_MOST))
            fits.append((max(c / (quality.CHAR_LIMIT + quality.CHAR_NOISE * few), w / limit if none > 0 else 0.0), c, w, none))
        return fits

    first = reference(passing)
    near = []
    for i in passing:
        _, c, w, none = min(every(i, first))
        if rows[i].lang in first and c <= 2 * quality.CHAR_LIMIT and w <= min(quality.WORD_LIMIT, quality.NONE_MOST * none):
            near.append(i)
    references = reference(near)
    for i, r in got.items():
        fits = every(i, references)
        excess = min(fits)[0]
        # Languages tie on texts without a common word: either's distances will do.
        assert any((r.char_distance, r.word_distance) == pytest.approx((c, w), abs=1e-6) for e, c, w, _ in fits if e < excess + 1e-9)
        if abs(excess - 1) > 1e-6:
            assert r.kept == (not r.base_failed and excess <= 1)
    assert 0 < sum(r.kept for r in got.values()) < len(got)
