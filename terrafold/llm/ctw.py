"""Language-model scoring by context-tree weighting over binary-decomposed bytes."""

from __future__ import annotations

import math
import sys
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stage, table
from .langid import remainder

DEPTH = 5
#: Words and byte grams that are broadcast at most: the commonest. Rarer ones are joined.
HEAD_WORDS, HEAD_GRAMS = 1 << 20, 1 << 21
WORD, GRAM = 0, 1
CHUNK = 1 << 21
END = b"\n"


def normal_words(text: str | None) -> list[bytes]:
    """Words cut at ASCII blanks, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def byte_grams(docs: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Every byte of every document with the ``depth`` bytes before it (line ends before the first), oldest byte highest; and
    the number of grams of each document."""
    pad = END * depth
    blob = np.frombuffer(b"".join(x for d in docs for x in (pad, d)), np.uint8).astype(np.uint64)
    sizes = np.array([len(d) for d in docs], np.int64)
    grams = np.zeros(max(len(blob) - depth, 0), np.uint64)
    for k in range(depth + 1):
        grams <<= np.uint64(8)
        grams |= blob[k : k + len(grams)]
    keep = np.ones(len(grams), bool)
    starts = np.cumsum(sizes + depth)[:-1]
    for k in range(depth):
        keep[starts - depth + k] = False
    return grams[keep], sizes


def in_chunks(batches: Iterator[pa.RecordBatch], n_cols: int) -> Iterator[list[tuple]]:
    """Rows of the batches with their text cut into words, in lists of about CHUNK bytes."""
    rows, size = [], 0
    for b in batches:
        for values in zip(*(b.column(i) for i in range(n_cols))):
            *other, text = (v.as_py() for v in values)
            rows.append((*other, normal_words(text)))
            size += len(text or "")
            if size >= CHUNK:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def gather(docs: DataFrame, depth: int) -> DataFrame:
    """``docs(learn, text)`` to ``(kind, key, n)``: occurrences in the learning documents of each word (XXH64) and of each byte
    gram; grams that only other documents have come with 0. Each task counts before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        words: Counter = Counter()
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def rows(kind: int, k: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(k), 100_000):
                part = k[at : at + 100_000].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int32)), pa.array(part), pa.array(n[at : at + 100_000])], ["kind", "key", "n"])

        def word_rows() -> Iterator[pa.RecordBatch]:
            k = np.fromiter(map(digest, words), np.uint64, len(words))
            yield from rows(WORD, k, np.fromiter(words.values(), np.int64, len(words)))
            words.clear()

        for chunk in in_chunks(batches, 2):
            for learn, ws in chunk:
                if learn:
                    words.update(ws)
                    words[END] += 1
            grams, sizes = byte_grams([b" ".join(ws) + END for _, ws in chunk], depth)
            learns = np.repeat(np.array([bool(x) for x, _ in chunk]), sizes)
            for of, weight in ((grams[learns], 1), (grams[~learns], 0)):
                of = np.sort(of)
                edge = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else np.zeros(0, np.int64)
                k, n = of[edge], np.diff(np.append(edge, len(of))) * weight
                keys, counts = np.concatenate((keys, k)), np.concatenate((counts, n))
            if len(keys) > 1_500_000:
                keys, where = np.unique(keys, return_inverse=True)
                counts = np.bincount(where, counts, len(keys)).astype(np.int64)
                if len(keys) > 1_000_000:
                    yield from rows(GRAM, keys, counts)
                    keys, counts = keys[:0], counts[:0]
            if len(words) > 600_000:
                yield from word_rows()
        yield from word_rows()
        keys, where = np.unique(keys, return_inverse=True)
        yield from rows(GRAM, keys, np.bincount(where, counts, len(keys)).astype(np.int64))

    return docs.select("learn", "text").mapInArrow(run, "kind int, key bigint, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def log_gamma(x: Column) -> Column:
    """Stirling's series, seven steps up from ``x`` > 0."""
    z, below = x + 7, x
    for i in range(1, 7):
        below = below * (x + i)
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - F.log(below)


def log_kt(zeros: Column, ones: Column) -> Column:
    """Krichevsky-Trofimov block probability of a sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - math.log(math.pi)


def _bits(grams: DataFrame) -> DataFrame:
    """Eight rows of each gram: the node of its context and of the bits so far, and the next bit."""
    byte = F.col("key").bitwiseAND(F.lit(255))
    context = F.shiftleft(F.shiftright("key", 8), 8)
    steps = F.array(*(F.struct((context + F.lit(1 << i) + F.shiftright(byte, 8 - i)).alias("node"), F.shiftright(byte, 7 - i).bitwiseAND(F.lit(1)).alias("bit")) for i in range(8)))
    return grams.select("key", "n", F.explode(steps).alias("x")).select("key", "n", "x.node", "x.bit")


def gram_scores(grams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``grams(key, n)`` to ``(key, n, score)``: log10 of the byte's probability after its context.

    Bottom up, a node's weighted probability is half its own KT estimate and half the product of its children's. Top down, a bit's
    probability mixes the KT estimates of all depths on the path, each by the posterior that the tree ends there; it stops where
    the context goes on to one never learned. One join for each depth, on the node; nothing of the tree comes to the driver.
    """
    def context_of(d: int) -> Column:
        return F.col("node").bitwiseAND(F.lit((1 << 8 * (d + 1)) - 1))

    bits = _bits(grams)
    sums = [F.sum(F.when(F.col("bit") == k, F.col("n")).otherwise(0)).alias(name) for k, name in ((0, "zeros"), (1, "ones"))]
    own = log_kt(F.col("zeros"), F.col("ones"))
    levels = {depth: stage(bits.groupBy("node").agg(*sums).withColumn("below", F.lit(0.0)).withColumn("weighted", own), "ctw-level")}
    for d in range(depth - 1, -1, -1):
        up = levels[d + 1].select(context_of(d).alias("node"), "zeros", "ones", "weighted").groupBy("node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("below"))
        top = F.greatest(own, F.col("below"))
        levels[d] = stage(up.withColumn("weighted", top + F.log(0.5 * F.exp(own - top) + 0.5 * F.exp(F.col("below") - top))), "ctw-level")
    seen = F.col("zeros") + F.col("ones") > 0
    kt = (F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1.0)
    ends = F.exp(own - math.log(2) - F.col("weighted"))
    state = levels[0].select("node", kt.alias("stop"), (ends * kt).alias("mixed"), (1 - ends).alias("left"))
    for d in range(1, depth + 1):
        here = levels[d].withColumn("up", context_of(d - 1)).join(state.withColumnRenamed("node", "up"), "up")
        stop = F.when(seen, F.col("mixed") + F.col("left") * kt).otherwise(F.col("stop"))
        last = d == depth
        state = here.select("node", stop.alias("stop"), *([] if last else [(F.col("mixed") + F.col("left") * ends * kt).alias("mixed"), (F.col("left") * (1 - ends)).alias("left")]))
    p = F.when(F.col("bit") == 1, F.col("stop")).otherwise(1 - F.col("stop"))
    out = stage(bits.join(state, "node").groupBy("key").agg(F.first("n").alias("n"), F.sum(F.log10(p)).alias("score")), "gram-scores")
    discard(*levels.values())
    return out


class Lookup:
    """Values by unsigned 64-bit key in an open hash table, whole arrays at a time."""

    EMPTY = np.uint64((1 << 64) - 1)

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys) * 2).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.values = np.full(1 << bits, self.EMPTY), np.zeros(1 << bits, np.float32 if values.dtype.kind == "f" else np.int64)
        left, spot = np.arange(len(keys)), self._home(keys)
        while len(left):
            at = spot[left]
            _, first = np.unique(at, return_index=True)
            first = first[self.keys[at[first]] == self.EMPTY]
            self.keys[at[first]], self.values[at[first]] = keys[left[first]], values[left[first]]
            left = np.delete(left, first)
            spot[left] = (spot[left] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where missing) and if they were found."""
        at = self._home(keys)
        got = self.keys[at]
        found = got == keys
        out = np.where(found, self.values[at], 0)
        left = np.flatnonzero(~found & (got != self.EMPTY))
        at = at[left]
        while len(left):
            at = (at + 1) & self.mask
            got = self.keys[at]
            hit = got == keys[left]
            out[left[hit]], found[left[hit]] = self.values[at[hit]], True
            on = ~hit & (got != self.EMPTY)
            left, at = left[on], at[on]
        return out, found


def head_of(counts: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Splits ``counts(.., n)`` by a power of two, so that the head has ``most`` rows at most: it and the rest."""
    size = F.floor(F.log2(F.col("n") + 1)).cast("int")
    per = {r.b: r.rows for r in counts.groupBy(size.alias("b")).agg(F.count("*").alias("rows")).collect()}
    least, total = 64, 0
    for b in sorted(per, reverse=True):
        total += per[b]
        if total > most:
            break
        least = b
    return counts.where(size >= least), counts.where(size < least)


def _arrays(df: DataFrame, *cols: str) -> list[np.ndarray]:
    got = df.select(*cols).toArrow()
    return [got.column(c).to_numpy() for c in cols]


def ctw_scores(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, head_words: int = HEAD_WORDS, head_grams: int = HEAD_GRAMS) -> DataFrame:
    """One row for each input row: ``doc_id, learned, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte``.

    ``learn`` says which rows teach. Scores are log10 probabilities: of the words and one end under add-one word counts, and of the
    same words, joined by single blanks and ended by a line end, byte by byte, under the context tree. Common words and grams,
    bounded in number, are broadcast; the rest of a document's are joined on their key. Null texts are empty and score their end;
    null ids and repeated rows stay; other columns are ignored. With nothing to learn from, every bit has the probability one half.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(learn, F.lit(True)).alias("learn"), F.col(text_col).alias("text"))
    counts = stage(gather(rows, depth), "counts")
    words = counts.where(F.col("kind") == WORD).select("key", "n")
    n_train, n_types = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    scored = gram_scores(counts.where(F.col("kind") == GRAM), depth)
    (word_head, word_tail), (gram_head, gram_tail) = head_of(words, head_words), head_of(scored, head_grams)
    shared = spark.sparkContext.broadcast((_arrays(word_head, "key", "n"), _arrays(gram_head, "key", "score")))
    below, token = math.log10(n_train + n_types + 1), uuid.uuid4().hex
    schema = "row long, doc_id long, learned boolean, n_tokens long, n_bytes long, n_known long, base double, score double, tail array<struct<kind:int,key:long,n:long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = sys.__dict__.setdefault("_terrafold_lookups", {})  # a worker process runs many tasks
        if (key := token) not in cache:
            cache.clear()
            (wk, wn), (gk, gs) = shared.value
            cache[key] = Lookup(wk.view(np.uint64), wn), Lookup(gk.view(np.uint64), gs)
        find_word, find_gram = cache[key]
        digest = xxhash.xxh64_intdigest
        for chunk in in_chunks(batches, 4):
            n_tokens = np.array([len(r[3]) + 1 for r in chunk], np.int64)
            hashes = np.array([digest(w) for r in chunk for w in (*r[3], END)], np.uint64)
            who = np.repeat(np.arange(len(chunk)), n_tokens)
            n, found = find_word(hashes)
            base = np.bincount(who, np.where(found, np.log10(n + 1.0) - below, 0.0), len(chunk))
            known = np.bincount(who, found & (n > 0), len(chunk)).astype(np.int64)
            grams, sizes = byte_grams([b" ".join(r[3]) + END for r in chunk], depth)
            gram_who = np.repeat(np.arange(len(chunk)), sizes)
            s, gram_found = find_gram(grams)
            score = np.bincount(gram_who, s, len(chunk))
            tails: list[list] = [[] for _ in chunk]
            for kind, k, w, miss in ((WORD, hashes, who, ~found), (GRAM, grams, gram_who, ~gram_found)):
                for (doc, x), times in Counter(zip(w[miss].tolist(), k[miss].view(np.int64).tolist())).items():
                    tails[doc].append({"kind": kind, "key": x, "n": times})
            tail = pa.array(tails, pa.list_(pa.struct([("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int64())])))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in chunk], pa.int64()), pa.array([r[1] for r in chunk], pa.int64()), pa.array([r[2] for r in chunk]), pa.array(n_tokens), pa.array(sizes), pa.array(known), pa.array(base), pa.array(score), tail],
                ["row", "doc_id", "learned", "n_tokens", "n_bytes", "n_known", "base", "score", "tail"],
            )

    heads = stage(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "learn", "text").mapInArrow(run, schema), "score-heads")
    tails = heads.select("row", F.explode("tail").alias("t")).select("row", "t.*")
    word_rows = tails.where(F.col("kind") == WORD).join(word_tail.withColumnRenamed("n", "c"), "key", "left")
    c = F.coalesce("c", F.lit(0))
    word_rows = word_rows.select("row", F.when(c > 0, F.col("n")).otherwise(0).alias("n_known"), (F.col("n") * (F.log10(c + 1.0) - below)).alias("base"), F.lit(0.0).alias("score"))
    gram_rows = tails.where(F.col("kind") == GRAM).join(gram_tail.select("key", F.col("score").alias("s")), "key")
    gram_rows = gram_rows.select("row", F.lit(0).cast("long").alias("n_known"), F.lit(0.0).alias("base"), (F.col("n") * F.col("s")).alias("score"))
    more = word_rows.union(gram_rows).groupBy("row").agg(F.sum("n_known").alias("k"), F.sum("base").alias("b"), F.sum("score").alias("s"))
    zero = lambda x: F.coalesce(x, F.lit(0))
    score = F.col("score") + zero("s")
    return heads.drop("tail").join(more, "row", "left").select(
        "doc_id", "learned", "n_tokens", (F.col("n_known") + zero("k")).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + zero("b")).alias("base_score"), score.alias("score"), (-score / F.col("n_bytes") / math.log10(2)).alias("bits_per_byte"),
    )


def op7_lm(spark, sf_dir: str) -> DataFrame:
    """Contract: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learns where crc32(doc_id) mod 7 is not 2."""
    out = ctw_scores(table(spark, sf_dir, "documents"), remainder("doc_id", 7) != 2)
    return out.withColumn("held_out", ~F.col("learned")).drop("learned")
