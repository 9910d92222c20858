"""Spelling variants: words one edit apart, by merging the light subtrees of their trie with one character skipped or replaced."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, discard, stage, table

LETTER_RUN = r"[A-Za-zÀ-ÿ]"
#: Shortest words, fewest occurrences, and how often a form must occur for each occurrence of its variant.
LEAST_LENGTH, LEAST_N, RATIO = 7, 2, 10
#: Of so many occurrences about one loses a character, by the checksum of id and run.
DAMAGED = 31
#: Ends each word in the trie, and stands for the replaced character; no word holds either.
END, HOLE = "\x00", "\x01"


def corpus_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_n: int = LEAST_N, damaged: int | None = DAMAGED) -> DataFrame:
    """``(word, n)``: maximal runs of letters of all whole texts, A-Z lower-cased, and how often they occur, counted before the shuffle.

    Where ``damaged`` divides the checksum of ``<id>:<run>``, the run loses the code point that the checksum names; None: none does.
    Null texts have no word, a null id counts as an empty one, repeated rows count each; other columns are ignored. Runs too short to
    count are never extracted: a run of enough letters is maximal wherever it is met. Empty input: no rows.
    """
    found = F.explode(F.regexp_extract_all(F.col("text"), F.lit(f"{LETTER_RUN}{{{least_length},}}"), F.lit(0)))
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text")).select("id", found.alias("run"))
    word: Column = ascii_lower(F.col("run"))
    if damaged:
        h = F.crc32(F.concat("id", F.lit(":"), word))
        at = F.pmod(h, F.length(word)).cast("int")
        word = F.when(F.pmod(h, F.lit(damaged)) == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)
    return runs.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def _light_places(words: DataFrame) -> DataFrame:
    """``words(word, n)`` to ``(word, n, at, heavy)``: each place (from 1) at which a word leaves a heavy path of the trie, and that path's
    next character. Words end with END, so an end can be the light or the heavy child.

    The heavy child of a node has the most words below, so a word leaves heavy paths a logarithmic number of times at most, and as many
    edges are light as there are words. Counting nodes combines before the shuffle; children of a node are as few as letters.
    """
    whole = F.concat("word", F.lit(END))
    paths = words.select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word") + 1)).alias("at")).withColumn("node", F.substring(whole, F.lit(1), F.col("at")))
    nodes = paths.groupBy("node").agg(F.count("*").alias("below"))
    last = F.substring("node", -1, 1)
    parent = F.substring(F.col("node"), F.lit(1), F.length("node") - 1).alias("parent")
    children = nodes.groupBy(parent).agg(F.max(F.struct("below", last.alias("c")))["c"].alias("heavy"), F.collect_list(last).alias("cs")).where(F.size("cs") > 1)
    light = children.select("parent", "heavy", F.explode("cs").alias("c")).where("c <> heavy").select(F.concat("parent", "c").alias("node"), "heavy")
    return paths.join(light, "node").select("word", "n", "at", "heavy")


def near_words(words: DataFrame) -> DataFrame:
    """``words(word, n)``, distinct and staged, to ``(word, n_near, form, form_n)``: how many other words are one inserted, deleted or
    replaced code point away, and the one of them with the largest n (ties: the first in code-point order). Words without any: no row.

    Two such words part at a node of the trie, where one of them at least takes a light edge. What hangs there is merged with one
    character replaced by the heavy one, put before it or skipped, and meets the whole words; light siblings, merged with a hole for
    their character, meet each other. A pair meets in one of these ways only, once. Light siblings with the same rest are as few as
    letters and summed without pairing them.
    """
    places = stage(_light_places(words), "light-places")
    whole = F.concat("word", F.lit(END))
    before, here, after = (F.substring(whole, F.lit(1), F.col("at") - 1), F.substring(whole, F.col("at"), F.lit(1)), F.substring(whole, F.col("at") + 1, F.length(whole)))
    letter, path = here != END, F.col("heavy") != END
    merged = F.array(
        F.when(letter & path, F.concat(before, "heavy", after)),
        F.when(path, F.concat(before, "heavy", here, after)),
        # Of equal characters in a row the last is skipped: there the two words part.
        F.when(letter & (F.substring(after, 1, 1) != here), F.concat(before, after)),
    )
    variants = places.select("word", "n", F.explode(F.array_compact(merged)).alias("end"))
    ends = words.select(whole.alias("end"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    met = variants.join(ends, "end").select(F.explode(F.array(F.struct("word", F.col("other").alias("w"), F.col("other_n").alias("m")), F.struct(F.col("other").alias("word"), F.col("word").alias("w"), F.col("n").alias("m")))).alias("x"))
    pairs = met.select("x.word", F.lit(1).cast("long").alias("k"), F.struct((-F.col("x.m")).alias("less"), F.col("x.w").alias("w")).alias("best"))

    hole = places.where(letter).select(F.concat(before, F.lit(HOLE), after).alias("hole"), F.struct((-F.col("n")).alias("less"), F.col("word").alias("w")).alias("me"))
    siblings = hole.groupBy("hole").agg(F.array_sort(F.collect_list("me")).alias("all")).where(F.size("all") > 1)
    each = siblings.select("all", F.posexplode("all").alias("pos", "me"))
    lights = each.select(F.col("me.w").alias("word"), (F.size("all") - 1).cast("long").alias("k"), F.when(F.col("pos") == 0, F.col("all")[1]).otherwise(F.col("all")[0]).alias("best"))

    near = pairs.unionByName(lights).groupBy("word").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))
    out = stage(near.select("word", "n_near", F.col("best.w").alias("form"), (-F.col("best.less")).alias("form_n")), "near-words")
    discard(places)
    return out


def group_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``words(word, n)``, words distinct, n above 0, to ``(word, form, root, n, n_near, form_n)``.

    ``form`` is the near word (`near_words`) of largest n if that is ``ratio`` times the word's or more, else null; ``root`` is where
    forms lead, the word itself if nowhere. Each step multiplies n, so their number is bounded by its logarithm and a few joins that
    double what a step spans find all roots. Empty input: no rows.
    """
    words = stage(words.select("word", "n"), "words")
    near = near_words(words)
    known = words.join(near, "word", "left").withColumn("has", F.coalesce(F.col("form_n") >= ratio * F.col("n"), F.lit(False)))
    forms = stage(
        known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("has"), F.col("form")).alias("form"), F.when(F.col("has"), F.col("form_n")).alias("form_n")),
        "forms",
    )
    ends = words.agg(F.max("n").alias("most"), F.min("n").alias("least")).first()
    steps = int(math.log(ends.most / ends.least, ratio)) + 1 if ends.most else 0
    roots = forms.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = stage(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    discard(words, near)
    return forms.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark, sf_dir: str) -> DataFrame:
    """Contract: word, form, root, n, n_near, form_n."""
    return group_variants(corpus_words(table(spark, sf_dir, "documents")))


#: Nearness by shared deletions: w minus one code point equals the other, or both minus one at the same place.
OP13_SQL = r"""
WITH RECURSIVE bits AS (SELECT list(list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8]::UBIGINT[], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
once AS (SELECT id, run, count(*) AS n, hex(encode(id || ':' || run)) AS x FROM runs GROUP BY id, run),
sums AS (SELECT run, n, xor(list_reduce(list_concat([4294967295]::UBIGINT[], [('0x' || x[2 * i + 1 : 2 * i + 2])::UBIGINT FOR i IN range(length(x) // 2)]), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::INT + 1])), 4294967295::UBIGINT) AS h FROM once, bits),
damaged AS (SELECT CASE WHEN h % 31 = 0 THEN run[1 : (h % length(run))::INT] || run[(h % length(run))::INT + 2 :] ELSE run END AS word, n FROM sums),
words AS (SELECT word, sum(n)::BIGINT AS n FROM damaged WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (SELECT DISTINCT word, n, i, word[1 : i - 1] || word[i + 1 :] AS less FROM words, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
near AS (
    SELECT a.word, b.word AS w, b.n AS m FROM cut a JOIN cut b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.less = b.word
    UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.less = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(w, (-m, w)) AS w, max(m) AS m FROM near GROUP BY word),
forms AS (SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN w END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM words LEFT JOIN best USING (word)),
ways AS (SELECT word, form AS root, 1 AS step FROM forms WHERE form IS NOT NULL UNION ALL SELECT s.word, f.form, step + 1 FROM ways s JOIN forms f ON s.root = f.word WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(root, step) AS root FROM ways GROUP BY word)
SELECT forms.word, form, coalesce(root, forms.word) AS root, n, n_near, form_n FROM forms LEFT JOIN roots USING (word)
"""
