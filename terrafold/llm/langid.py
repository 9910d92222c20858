"""Language identification: known words first, then progressively shorter character n-grams."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stage, table

#: Characters of labelled texts that the model is fitted on, for each language about so many, in pieces of PIECE characters by a hash
#: of id, text and place. The model holds every word and n-gram of them, so this bounds its size, however long a text is.
FIT_CHARS, PIECE = 8_000_000, 2000
LONGEST = 4
#: Bytes of word scores that a task remembers.
MEMORY = 64 << 20
LETTERS = re.compile(r"[^\W\d_]+")


def remainder(id_col: str, of: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(of)), F.lit(0))


def words_of(text: str | None) -> Counter:
    """Runs of letters (the Unicode categories L) of the lower-cased text and how often each occurs."""
    found = Counter(LETTERS.findall((text or "").lower()))
    for run in [w for w in found if not w.isalpha()]:  # holds numbers that are no digits, such as a half
        n = found.pop(run)
        for w in "".join(c if c.isalpha() else " " for c in run).split():
            found[w] += n
    return found


def fit(docs: DataFrame, fit_chars: int = FIT_CHARS) -> dict:
    """``docs(doc_id, text, lang)`` to the model: log frequencies by language of all words and n-grams of the sample, and what an
    unseen one gets.

    Rows without text or language teach nothing. A language with up to ``fit_chars`` characters is taken whole; of others each piece of
    each text has the same chance, null and repeated ids alike, so that about ``fit_chars`` come, and the piece with the least draw
    always does; letters cut off at a piece's ends go. The sample's words are counted once and staged; what comes to the driver is
    bounded by the sample.
    """
    known = docs.where("text is not null and lang is not null").select("lang", "text", F.char_length("text").cast("long").alias("size"), F.xxhash64("doc_id", "text").alias("h"))
    # The chance of a piece is uniform, so the least draw of a language's first pieces is one of its least.
    draw = lambda i: F.pmod(F.xxhash64(F.col("h"), i), F.lit(1 << 53)) / F.lit(float(1 << 53))
    per = known.groupBy("lang").agg(F.sum("size").alias("in_lang"), F.min(draw(F.lit(0).cast("long"))).alias("least"))
    rate = F.greatest(F.col("least"), F.lit(fit_chars) / F.col("in_lang"))
    drawn = F.filter(F.sequence(F.lit(0).cast("long"), F.floor((F.greatest("size", F.lit(1)) - 1) / PIECE)), lambda i: draw(i) <= rate)
    piece = lambda i: F.regexp_replace(F.substring(F.col("text"), (i * PIECE + 1).cast("int"), F.lit(PIECE)), r"^\p{L}+|\p{L}+$", "")
    taken = F.when(F.col("in_lang") <= fit_chars, F.array("text")).otherwise(F.transform(drawn, piece))
    # A row for each language, which the labels of a corpus bound.
    sample = known.join(F.broadcast(per), "lang").select("lang", F.explode(taken).alias("text"))
    word = F.explode(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: w != ""))
    words = stage(sample.select("lang", word.alias("x")).groupBy("lang", "x").agg(F.count("*").alias("n")), "fit-words")
    padded = F.concat(F.lit("_"), F.col("x"), F.lit("_"))

    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1)))
        return F.when(F.length(padded) >= n, F.transform(starts, lambda i: F.substring(padded, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    grams = F.flatten(F.array(*map(runs, range(1, LONGEST + 1))))
    cut = words.select("lang", "n", F.explode(grams).alias("x")).where("x <> '_'").groupBy("lang", "x").agg(F.sum("n").alias("n"))
    langs = sorted(r.lang for r in words.select("lang").distinct().collect())
    model = {"langs": langs}
    for name, counts in (("words", words), ("grams", cut)):
        got = counts.groupBy("x").agg(*(F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("n"))), F.lit(0)).alias(f"n{k}") for k, x in enumerate(langs))).orderBy("x").toArrow() if langs else None
        model[name] = {} if got is None else _logs(got)
    discard(words)
    return model


def _logs(counts: pa.Table) -> dict:
    """A table of counts by language, sorted by its first column, to ``{"x": .., "logs": ..}``."""
    n = np.array([c.to_numpy() for c in counts.columns[1:]], float).T
    totals = np.maximum(n.sum(axis=0), 1)
    return {"x": counts.column(0).combine_chunks(), "logs": np.log(np.where(n > 0, n, 0.1) / totals).astype(np.float32)}


class Scorer:
    """Log frequencies of words by language; a bounded memory of the words met."""

    def __init__(self, model: dict):
        self.langs = model["langs"]
        self.words, self.grams = ({x: k for k, x in enumerate(model[name]["x"].to_pylist())} if model[name] else {} for name in ("words", "grams"))
        self.word_logs, self.gram_logs = (model[name]["logs"] if model[name] else None for name in ("words", "grams"))
        self.room = max(1024, MEMORY // (8 * max(len(self.langs), 1)))
        self.chunk = max(512, self.room // 4)
        self.place: dict[str, int] = {}
        self.rows = np.zeros((min(self.room, 4096), len(self.langs)))

    def word(self, w: str) -> np.ndarray:
        """The word's own log frequencies if the model knows it, else the mean of those of its longest known n-grams."""
        known = self.words.get(w)
        if known is not None:
            return self.word_logs[known]
        padded = f"_{w}_"
        for n in range(LONGEST, 0, -1):
            found = [k for i in range(len(padded) - n + 1) if (k := self.grams.get(padded[i : i + n])) is not None]
            if found:
                return self.gram_logs[found].mean(axis=0)
        return np.zeros(len(self.langs))

    def text(self, text: str | None) -> tuple[str, float]:
        counts = words_of(text)
        if not counts or not self.langs:
            return "und", 0.0
        total = np.zeros(len(self.langs))
        items = list(counts.items())
        for at in range(0, len(items), self.chunk):
            chunk = items[at : at + self.chunk]
            if len(self.place) + len(chunk) > self.room:
                self.place.clear()
            spots = []
            for w, _ in chunk:
                k = self.place.get(w)
                if k is None:
                    k = self.place[w] = len(self.place)
                    if k >= len(self.rows):
                        self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                    self.rows[k] = self.word(w)
                spots.append(k)
            total += np.fromiter((n for _, n in chunk), float, len(chunk)) @ self.rows[spots]
        total /= math.sqrt(sum(counts.values()))
        odds = np.exp(total - total.max())
        best = int(odds.argmax())
        return self.langs[best], float(odds[best] / odds.sum())


def identify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score)``, one row for each input row, repeated rows and null ids included; only the text decides, other
    columns are ignored, whatever their names. Empty input: no rows.

    Null texts and texts without a letter (Unicode categories L) get ``und`` and 0, as does everything under a model without
    languages. Ties go to the first language by name. Whole texts, however long: a task holds one text's distinct words. The model is
    broadcast: its size is bounded by the fit.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            got = [scorer.text(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def op5_langid(spark, sf_dir: str) -> DataFrame:
    """Contract: doc_id, held_out, lang_pred, score; learned from documents whose crc32(doc_id) mod 4 is not 2."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(remainder("doc_id", 4) != 2).select("doc_id", "text", "lang"))
    return identify(docs, model).withColumn("held_out", remainder("doc_id", 4) == 2)
