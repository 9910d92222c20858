"""BPE by speculation against the tokenizers library and against plain merging."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from terrafold.llm.common import stage
from terrafold.llm.queries import QUERIES
from terrafold.llm.word_bpe import Encoder, Merges, decode_ids, encode_texts
from tests.support import SF

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_op11_equals_the_library(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = QUERIES["op11_word_bpe"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


BITS = ["a", "e", "st", "'", "'s", "'LL", " ", "\n", "\t", "1", "9", "É", "é", "ß", "İ", "Σ", "ς", "漢", "\U0001f600", "\x00", "\x1c", "\x85", "᠎", "\xa0", " ", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "!!", "...", "th", "ing", "Ж", "ี", "Ⅷ", "​", "aaaa", "lll"]


def test_odd_characters(library):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(BITS) for _ in range(rnd.randint(0, 40))) for _ in range(4000)]
    texts += ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(1, 30))) for _ in range(4000)]
    texts += [c * k for c in ("a", "ab", "th", "l") for k in range(1, 80)] + ["", " \n ", "z" * 100_000, "the " * 50_000]
    assert [x.tolist() for x in Encoder(PATH)(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def plain(model, word):
    """Merging as defined: the lowest rank, leftmost first, one at a time."""
    ranks = {tuple(m): k for k, m in enumerate(model["merges"])}
    parts = list(word)
    while len(parts) > 1:
        r, k = min((ranks.get((a, b), 10**9), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
        if r == 10**9:
            break
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return [model["vocab"][p] for p in parts]


@pytest.mark.parametrize("seed", range(12))
def test_any_merges(seed):
    """Random vocabularies, also with two merges for one token and parts that come later than their whole."""
    rnd = random.Random(seed)
    known, merges = list("abc"), []
    for _ in range(40):
        a, b = rnd.choice(known), rnd.choice(known)
        if len(a + b) < 9 and [a, b] not in merges:
            merges.append([a, b])
            known += [a + b] * (a + b not in known)
    if seed % 3 == 0:
        rnd.shuffle(merges)
    model = {"vocab": {t: k for k, t in enumerate(known)}, "merges": merges}
    words = ["".join(rnd.choice("abc") for _ in range(rnd.randint(1, 24))) for _ in range(600)]
    ids, sizes = Merges(model).encode(words)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [plain(model, w) for w in words]


def test_borders_by_definition():
    """Two tokens stay apart if merging their joined characters gives them back."""
    merges = Encoder(PATH).merges
    rnd = np.random.default_rng(3)
    inner = [t for t in range(merges.size) if merges.rank[t] >= 0]
    names = {v: k for k, v in merges.vocab.items()}
    lefts = [t for t in inner if not names[t].endswith("</w>")]
    a, b = rnd.choice(lefts, 3000), rnd.choice(inner, 3000)

    def characters(t):
        return [t] if merges.rank[t] < 0 else characters(int(merges.left[t])) + characters(int(merges.right[t]))

    pairs = [characters(x) + characters(y) for x, y in zip(a.tolist(), b.tolist())]
    ids, sizes = merges.merged(np.array([i for p in pairs for i in p]), np.array([len(p) for p in pairs]))
    want = [g.tolist() == [x, y] for g, x, y in zip(np.split(ids, np.cumsum(sizes)[:-1]), a.tolist(), b.tolist())]
    assert merges.apart(a, b).tolist() == want and True in want and False in want


def test_odd_tables(spark, library):
    rows = [(1, None, "x"), (2, "", "y"), (None, "Hello world", "z"), (3, "Hello world", "z"), (3, "Hello world", "z"), (4, "word " * 200_000, None)]
    docs = stage(spark.createDataFrame(rows, "doc_id long, text string, ids string"), "odd-bpe")
    got = {(r.doc_id, r.decoded): list(r.ids) for r in decode_ids(encode_texts(docs, PATH), PATH).collect()}
    assert got[1, ""] == got[2, ""] == [] and len(got) == 5
    for key, text in ((None, "Hello world"), (3, "Hello world"), (4, "word " * 200_000)):
        ids = library.encode(text, add_special_tokens=False).ids
        assert got[key, library.decode(ids, skip_special_tokens=False)] == ids
    assert encode_texts(docs, PATH).count() == 6 and encode_texts(docs.limit(0), PATH).count() == 0


def test_a_file_that_cuts_otherwise(spark):
    """Texts go whole to a rule that keeps blanks with words; the file has no decoder of its own here."""
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    library = Tokenizer.from_file(path)
    texts = ["Hello  world\n it's <|endoftext|> 42 café", "", " x  y "]
    assert [x.tolist() for x in Encoder(path)(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
