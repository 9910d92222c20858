"""Quality rules from distribution divergence, DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANK_CLASS, WORD_CLASS, discard, stage, table, with_row_id, without_rows

# The commonest function words of each language that has a reference.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "it", "that", "for", "was", "with", "on", "are", "at", "be", "by", "from", "this"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein", "eine"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "sur", "au"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para"],
}
# Character classes, each counted on what the ones before it left; the rest is the class "other". A word with a digit
# (a number, an address, a key) counts as one digit: its length says nothing of the language.
CHAR_CLASSES = [("lower", r"\p{Ll}"), ("blank", r"[\x20\x09-\x0D]"), ("upper", r"\p{Lu}"), ("digit", r"\p{Nd}"), ("stop", r"[.,;:?'\x22()\-]"), ("symbol", r"[#*$%&|<>]"), ("mark", r"[!_=+~^@/\\{}\[\]]"), ("letter", r"[\p{L}\p{M}]")]
SYMBOLS = "#*$%&|<>"
WORDS = sorted({w for ws in COMMON_WORDS.values() for w in ws})

#: A text fails if no language has both distances under a limit plus what so few words deviate by chance (NOISE over the square
#: root of their number); words count from MIN_WORDS on, characters from MIN_CHARS on.
CHAR_LIMIT, CHAR_NOISE, WORD_LIMIT, WORD_NOISE = 0.12, 0.5, 0.35, 1.2
MIN_CHARS, MIN_WORDS = 80, 60
#: Nor may the word distance pass this part of the distance of a text without any common word, and what so few words deviate by
#: chance; from NONE_MOST on a text counts as one without.
NONE_SHARE, NONE_NOISE, NONE_MOST = 0.7, 2.2, 0.985
WINDOW = 8
#: Common words taken from the data for each language that has no list above.
OWN_WORDS = 18
#: Parts of a language's distinct words, and rows by language up to which a table of them is sent to all tasks.
WORD_PARTS, MOST_LANGUAGES = 256, 10_000


def small(by_lang: DataFrame) -> DataFrame:
    """A staged table with a row of bounded size for each language: broadcast up to MOST_LANGUAGES rows, joined as Spark sees fit beyond."""
    return F.broadcast(by_lang) if by_lang.limit(MOST_LANGUAGES + 1).count() <= MOST_LANGUAGES else by_lang


def own_words(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(lang, own_words)``: for each language named in ``docs`` and not in COMMON_WORDS, the words most of its texts of 20 words or
    more hold, at most OWN_WORDS."""
    others = docs.where(~F.col(lang_col).isin(list(COMMON_WORDS))).select(F.col(lang_col).alias("lang"), F.array_remove(F.split(text_col, BLANK_CLASS + "+"), "").alias("words"))
    held = others.where(F.size("words") >= 20).select("lang", F.explode(F.array_distinct("words")).alias("word")).where(F.col("word").rlike(r"^[\p{L}\p{M}'’-]+$"))
    # The commonest of each part of a language's words first, so that no window holds them all.
    top = held.groupBy("lang", "word").agg(F.count("*").alias("n")).withColumn("part", F.pmod(F.xxhash64("word"), F.lit(WORD_PARTS)))
    for keys in (["lang", "part"], ["lang"]):
        order = Window.partitionBy(*keys).orderBy(F.col("n").desc(), "word")
        top = top.withColumn("k", F.row_number().over(order)).where(F.col("k") <= OWN_WORDS)
    return top.groupBy("lang").agg(F.array_sort(F.collect_list("word")).alias("own_words"))


def quality_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: ``doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long) and the histograms
    ``chars`` (one count for each of CHAR_CLASSES, then "other"), ``commons`` (one for each of WORDS) and ``own`` (one for each of
    the row's language's `own_words`; null for languages in COMMON_WORDS).

    Null texts count as empty: all zero. Whole texts; only the words of languages without a list are shuffled, as counts. Repeated windows are found on 64-bit hashes.
    """
    text, words, size = F.col("text"), F.col("words"), lambda c: F.char_length(c).cast("long")
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.join(small(stage(own_words(docs, text_col, lang_col), "own-words")), "lang", "left")
    cut = base.withColumn("words", F.array_remove(F.split("text", BLANK_CLASS + "+"), "")).withColumn("joined", F.array_join("words", " "))
    # Common words, each between blanks of its own, so that one replacement counts one word.
    hits = F.concat(F.lit(" "), F.array_join(F.filter(words, lambda w: w.isin(WORDS)), "  "), F.lit(" "))
    hashed = cut.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w))).withColumn("hits", hits)
    # A word with a digit becomes one digit.
    hashed = hashed.withColumn("left", F.regexp_replace("joined", r"(?<![^ ])[^ \p{Nd}]*+\p{Nd}[^ ]*", "0"))
    for k, (name, pattern) in enumerate(CHAR_CLASSES):
        hashed = hashed.withColumn(f"left{k}", F.regexp_replace("left" if k == 0 else f"left{k - 1}", f"{pattern}+", ""))
    last = len(CHAR_CLASSES) - 1
    lefts = [F.col("left"), *(F.col(f"left{k}") for k in range(last + 1))]
    chars = F.array(*(size(a) - size(b) for a, b in zip(lefts, lefts[1:])), size(lefts[-1]))
    commons = F.array(*(((size(F.col("hits")) - size(F.replace("hits", F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)).cast("long") for w in WORDS))
    own = F.transform("own_words", lambda w: F.size(F.filter(words, lambda x: x == w)).cast("long"))
    n_words = F.size(words).cast("long")
    counted = hashed.select(
        "doc_id", "lang", n_words.alias("n_words"), (size(F.col("joined")) - F.greatest(n_words - 1, F.lit(0))).alias("word_chars"), size(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).alias("n_symbols"), chars.alias("chars"), commons.alias("commons"), own.alias("own"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_CLASS)).alias("lines"), F.when(F.size("hashes") > WINDOW, _window_hashes(F.col("hashes"))).alias("windows"),
    )
    return counted.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), _repeat_words(F.col("windows")).alias("n_repeat_words"), "chars", "commons", "own",
    )


def _window_hashes(hashes: Column) -> Column:
    """Hashes of all runs of WINDOW elements."""
    return F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(WINDOW))))


def _repeat_words(windows: Column) -> Column:
    """Words covered by the windows that occur twice or more; only texts with a repeat pay for the sort."""
    def repeated(s: Column) -> Column:
        at = lambda i: F.get(s, i)["h"]
        marked = F.transform(s, lambda e, i: F.when((at(i - 1) == e["h"]) | (at(i + 1) == e["h"]), e["p"]))
        return F.sort_array(F.filter(marked, lambda p: p.isNotNull()))

    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    spots = F.get(F.transform(F.array(ordered), repeated), F.lit(0))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(
        spots, start, lambda a, p: F.struct((a["n"] + (p + WINDOW - F.greatest(a["end"], p)).cast("long")).alias("n"), (p + WINDOW).alias("end")), lambda a: a["n"]
    )
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), covered).otherwise(F.lit(0).cast("long"))


def language_references(features: DataFrame) -> dict[str, tuple[list[int], list[int], int]]:
    """Histograms of characters and common words and the word count of each language in COMMON_WORDS, over all rows that name it.

    What comes to the driver is one row of sums for each of these few languages.
    """
    n_chars, n_words = len(CHAR_CLASSES) + 1, len(WORDS)
    sums = [F.sum(F.get("chars", F.lit(i))) for i in range(n_chars)] + [F.sum(F.get("commons", F.lit(i))) for i in range(n_words)]
    rows = features.where(F.col("lang").isin(list(COMMON_WORDS))).groupBy("lang").agg(F.array(*sums[:n_chars]).alias("chars"), F.array(*sums[n_chars:]).alias("commons"), F.sum("n_words").alias("n")).collect()
    return {r.lang: (r.chars, r.commons, r.n) for r in rows}


def own_references(features: DataFrame) -> DataFrame:
    """``(lang, q_chars, q_own, q_n)`` as `language_references`, as a table: of each language not in COMMON_WORDS."""
    n_chars = len(CHAR_CLASSES) + 1
    sums = [F.sum(F.get("chars", F.lit(i))) for i in range(n_chars)], [F.sum(F.get("own", F.lit(i))) for i in range(OWN_WORDS)]
    found = features.where("own is not null").groupBy("lang").agg(F.array(*sums[0]).alias("q_chars"), F.array_compact(F.array(*sums[1])).alias("q_own"), F.sum("n_words").alias("q_n"))
    return stage(found, "own-references")


def trimmed_references(features: DataFrame) -> tuple[dict[str, tuple[list[int], list[int], int]], DataFrame]:
    """References, of `language_references` and `own_references`, of the rows that are near the references of all rows that pass the
    base rule: junk has no say in them."""
    passing = features.where((F.col("n_words") >= 20) & (100 * F.col("n_repeat_words") <= 30 * F.col("n_words")))
    first, own = language_references(passing), own_references(passing)
    near = with_distances(passing, first, own).where((F.col("best.c") <= 2 * CHAR_LIMIT) & (F.col("best.w") <= F.least(F.lit(WORD_LIMIT), NONE_MOST * F.col("best.none"))))
    # Without a reference a row's distances are 0, so only rows of languages with one are asked.
    near = near.where(F.col("lang").isin(list(first)) | F.col("own").isNotNull())
    return language_references(near) or first, own_references(near)


def js_distance(p: Column, q: list[float] | Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two distributions over the same bins: an array column, and constants or a column."""
    def term(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q if isinstance(q, Column) else F.array(*map(F.lit, q)), lambda a, b: term(a, b) + term(b, a))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda t, x: t + x) / 2, F.lit(0.0)))


def distance_without(share: float) -> float:
    """Distance of a text without common words from a reference of which they make up ``share``."""
    rest = 1 - share
    return math.sqrt(max(0.0, math.log2(2 / (1 + rest)) + (rest * math.log2(2 * rest / (1 + rest)) if rest else 0.0) + share) / 2)


def with_distances(features: DataFrame, references: dict[str, tuple[list[int], list[int], int]], own: DataFrame) -> DataFrame:
    """Adds ``best``: of the language whose larger distance, against its limit, is least, that ``excess``, the distances ``c`` of
    characters and ``w`` of common words, and ``none``, that of a text without any of its common words. Distances that a length guard or a missing reference leaves out count as 0. Rows of a
    language of ``own`` may also fit that one; rows whose language has no reference have the distances 0.
    """
    n_chars = F.aggregate("chars", F.lit(0).cast("long"), lambda a, x: a + x)
    df = features.withColumn("total_chars", n_chars).join(small(own), "lang", "left")
    fits, few = [], 1 / F.sqrt(F.greatest("n_words", F.lit(1)))
    for lang, (chars, commons, n_words) in sorted(references.items()):
        if not sum(chars) or not n_words:
            continue
        mine, own = [WORDS.index(w) for w in COMMON_WORDS[lang]], F.lit(0).cast("long")
        for i in mine:
            own = own + F.get("commons", F.lit(i))
        p_chars = F.transform("chars", lambda x: x / F.col("total_chars"))
        p_words = F.transform(F.array(*(F.get("commons", F.lit(i)) for i in mine), F.col("n_words") - own), lambda x: x / F.col("n_words"))
        q_words = [commons[i] / n_words for i in mine]
        by_char = F.when(F.col("total_chars") >= MIN_CHARS, js_distance(p_chars, [c / sum(chars) for c in chars])).otherwise(F.lit(0.0))
        by_word = F.when(F.col("n_words") >= MIN_WORDS, js_distance(p_words, [*q_words, max(0.0, 1 - sum(q_words))])).otherwise(F.lit(0.0))
        df = df.withColumn(f"fit_{lang}", F.struct(by_char.alias("c"), by_word.alias("w")))
        fits.append(_fit(F.col(f"fit_{lang}"), F.lit(distance_without(min(1.0, sum(q_words)))), few))
    df, own_fit = _own_fit(df, few)
    nothing = F.struct(*(F.lit(0.0).alias(c) for c in ("excess", "c", "w", "none")))
    judged = F.col("lang").isNull() | F.col("lang").isin(list(references)) | F.col("q_n").isNotNull()
    best = F.when(judged, F.coalesce(F.array_min(F.array(*fits, own_fit)), nothing)).otherwise(nothing)
    return df.withColumn("best", best)


def _own_fit(df: DataFrame, few: Column) -> tuple[DataFrame, Column]:
    """The fit of each row with its own language's reference from the data; null where there is none."""
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    rest = lambda c: F.aggregate(c, F.lit(1.0), lambda a, x: a - x)
    df = df.withColumn("q_words", F.transform("q_own", lambda x: x / F.greatest("q_n", F.lit(1)))).withColumn("p_words", F.transform("own", lambda x: x / F.greatest("n_words", F.lit(1))))
    df = df.withColumn("q_rest", F.greatest(rest("q_words"), F.lit(0.0))).withColumn("p_rest", F.greatest(rest("p_words"), F.lit(0.0)))
    by_char = js_distance(F.transform("chars", lambda x: x / F.greatest("total_chars", F.lit(1))), F.transform("q_chars", lambda x: x / F.greatest(total("q_chars"), F.lit(1))))
    by_word = js_distance(F.concat("p_words", F.array("p_rest")), F.concat("q_words", F.array("q_rest")))
    none = js_distance(F.concat(F.transform("q_words", lambda x: F.lit(0.0)), F.array(F.lit(1.0))), F.concat("q_words", F.array("q_rest")))
    df = df.withColumn("none_own", none).withColumn("fit_own", F.struct(F.when(F.col("total_chars") >= MIN_CHARS, by_char).otherwise(F.lit(0.0)).alias("c"), F.when(F.col("n_words") >= MIN_WORDS, by_word).otherwise(F.lit(0.0)).alias("w")))
    return df, F.when(F.col("q_n").isNotNull(), _fit(F.col("fit_own"), F.col("none_own"), few))


def _fit(fit: Column, none: Column, few: Column) -> Column:
    """The struct of `with_distances` for one language, of its distances and the distance of a text without its common words."""
    word_limit = F.least(WORD_LIMIT + WORD_NOISE * few, none * F.least(NONE_SHARE + NONE_NOISE * few, F.lit(NONE_MOST)))
    by_word = F.when(none > 0, fit["w"] / word_limit).otherwise(F.lit(0.0))
    return F.struct(F.greatest(fit["c"] / (CHAR_LIMIT + CHAR_NOISE * few), by_word).alias("excess"), fit["c"].alias("c"), fit["w"].alias("w"), none.alias("none"))


def with_verdict(features: DataFrame, references: dict[str, tuple[list[int], list[int], int]], own: DataFrame) -> DataFrame:
    """Adds ``base_failed``, ``kept``, ``char_distance`` and ``word_distance``."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = with_distances(features, references, own).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("best.excess") <= 1))
    return out.withColumns({"char_distance": F.col("best.c"), "word_distance": F.col("best.w")})


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id``, the counts of `quality_features` and the columns of `with_verdict`; texts are read once, references come from all
    rows.

    Null, empty and blank texts fail the base rule; repeated rows and null ids stay, one row out for each row in; other columns
    are ignored. A row is judged by the nearest of the languages in COMMON_WORDS that rows name and, if it names another, of that one,
    whose common words and characters come from its own rows. Where a row's language has no reference, only the base rule decides.
    Empty input: no rows.
    """
    features = stage(quality_features(docs, id_col, text_col, lang_col), "quality")
    out = with_verdict(features, *trimmed_references(features))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance")


def drop_low_quality(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs``, all columns, that the rules keep; edge cases as in `quality_rules`. ``docs`` must come from a scan."""
    keyed, row = with_row_id(docs)
    features = stage(quality_features(keyed, row, text_col, lang_col), "quality")
    bad = stage(with_verdict(features, *trimmed_references(features)).where(~F.col("kept")).select("doc_id"), "low-quality")
    out = without_rows(keyed, row, bad)
    discard(bad)
    return out


def op3_quality(spark, sf_dir: str) -> DataFrame:
    """Contract: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    return quality_rules(table(spark, sf_dir, "documents"))
