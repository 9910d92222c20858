"""SimHash near-duplicates by deletion-variant signatures."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .common import FileRange, bitmap, delete, discard, file_in, merged_joins, new_path, passes, sieve, small_batches, stage, table, with_row_id, without_rows

BITS = 64


def _votes(hashes: np.ndarray) -> int:
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        votes += np.unpackbits(hashes[at : at + (1 << 16), None].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def shingle_hashes(words: list[bytes], shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of ``shingle`` words, joined by one blank; fewer words: of the whole sequence; none: nothing."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], seed) for s, e in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())], np.uint64)


def fingerprint(text: str | None, shingle: int, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of a text: A-Z lower-cased, words cut at ASCII blanks, each shingle counting as often as it occurs.

    Fewer words than a shingle: the whole sequence is the one shingle. No word (null included): 0. A bit is 1 if over half of the
    shingles' XXH64 hashes have it. Shingles are slices of the joined words; votes are taken in blocks, so memory stays bounded.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return _votes(shingle_hashes(words, shingle, seed)) if words else 0


def with_fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """``docs(id, text)`` to ``(id, fp)``, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["id", "fp"])

    return docs.select("id", "text").mapInArrow(run, "id bigint, fp bigint")


def segments(distance: int) -> list[tuple[int, int]]:
    """(shift, width) of so few segments that, at ``distance`` differing bits, one of them differs by at most one."""
    n = distance // 2 + 1
    cuts = [BITS * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


Condition = Callable[[Callable[[str], Column], Callable[[str], Column]], Column]


def _side(df: DataFrame, name: str) -> DataFrame:
    return df.toDF(*(f"{name}_{c}" for c in df.columns))


def _of(name: str) -> Callable[[str], Column]:
    return lambda c: F.col(f"{name}_{c}")


def hamming_links(prints: DataFrame, distance: int, also: Condition | None = None, only: int | None = None) -> DataFrame:
    """``prints(id, fp, more..)``, ids distinct, to each pair ``(u, v)`` of ids whose prints differ in ``distance`` bits at most,
    once. ``also(a, b)``, on functions from a column's name to the column of either row, is a further condition of the join.
    ``only`` searches one segment: the calls for all segments share the pairs among them, and each indexes its part of the rows.

    For each segment a print is indexed by the segment's value and by each variant in which one bit is a wildcard. Pairs that
    differ in just that bit meet there, one side with 0 and one with 1; pairs with equal segments meet by value. The join
    verifies the whole distance and lets only the first matching segment speak, so no pair comes twice and nothing is expanded.
    It merges both sides: Spark's estimate of the index, made before the explode, is of one row a print, and would broadcast it.
    """
    fp, rows = F.col("fp"), []
    cuts = segments(distance)
    for s, (shift, width) in enumerate(cuts):
        if only not in (None, s):
            continue
        value = F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))
        rows.append(F.struct((value + F.lit((s << 56) | (63 << 48))).alias("key"), F.lit(None).cast("boolean").alias("one")))
        for bit in range(width):
            key = value.bitwiseAND(F.lit(_signed(((1 << 64) - 1) ^ (1 << bit)))) + F.lit((s << 56) | (bit << 48))
            rows.append(F.struct(key.alias("key"), (F.shiftright(value, bit).bitwiseAND(F.lit(1)) == 1).alias("one")))
    index = prints.select("*", F.explode(F.array(*rows)).alias("x")).select(*prints.columns, "x.*")
    left, right = _side(index.where("one is null or not one").drop("one"), "a"), _side(index.where("one is null or one").drop("one"), "b")
    a, b = _of("a"), _of("b")
    x, same = a("fp").bitwiseXOR(b("fp")), F.shiftright(a("key"), 48).bitwiseAND(F.lit(63)) == 63
    near: Column = (F.bit_count(x) <= distance) & (~same | (a("id") < b("id")))
    for s, (shift, width) in enumerate(cuts[:-1]):
        part = x.bitwiseAND(F.lit(_signed(((1 << width) - 1) << shift)))
        near = near & ((F.shiftright(a("key"), 56) <= s) | (F.bit_count(part) > 1))
    if also:
        near = near & also(a, b)
    joined = left.hint("merge").join(right, (a("key") == b("key")) & near)
    return joined.select(F.least(a("id"), b("id")).alias("u"), F.greatest(a("id"), b("id")).alias("v"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4) -> DataFrame:
    """Near-duplicate groups of documents: ``(doc_id, fp, component_id)``, one row for each input row.

    Texts of one fingerprint collapse before anything is paired; links between different fingerprints are complete.
    ``component_id`` is the smallest non-null id that links reach, itself included. Null and blank texts have the fingerprint 0
    and are linked like any other. Repeated rows stay; other columns are ignored, whatever their names. Empty input: no rows.
    """
    prints = stage(with_fingerprints(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), shingle), "prints")
    with merged_joins(docs.sparkSession):
        ids = stage(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "distinct-prints")
        roots = components(hamming_links(ids.select(F.col("fp").alias("id"), "fp"), distance))
        known = ids.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        groups = known.groupBy("root").agg(F.min("least").alias("least"), F.sum("n").alias("n"))
        named = stage(known.select("fp", "root").join(groups.where("n > 1"), "root").select("fp", F.col("least").alias("component_id")), "named-prints")
    discard(ids)
    return prints.join(named.hint("merge"), "fp", "left").select(F.col("id").alias("doc_id"), "fp", F.coalesce("component_id", "id").alias("component_id"))


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    """Contract: doc_id, fingerprint (16 hex digits), component_id."""
    out = simhash_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Near copies for `drop_near_copies`: word shingles and their Jaccard similarity. A first round joins the bulk of large groups: a
#: SimHash of the shingles within COPY_BITS, by deletion-variant signatures; and one of the distinct words, which a few edits hardly move,
#: within WORD_BITS under one of the hash seeds, with the upper 48 bits of that of the shingles within SHINGLE_BITS. What these leave
#: apart, an exact join finds.
COPY_SHINGLE, COPY_SIMILARITY, COPY_BITS, WORD_BITS, SHINGLE_BITS = 5, 0.8, 4, 7, 16
WORD_SEEDS = (42, 43)
#: Steps of the number of shingles in `_check`, for each factor of e.
SIZE_STEPS = 2048
#: Shingles that two texts of one task's sample hold are counted as common, in one of COMMON_SAMPLE rows; the COMMON_MOST commonest come
#: last in each text's prefix, so that rare ones are met first. They only order the shingles: any order finds all pairs.
COMMON_SAMPLE, COMMON_MOST = 4, 1 << 18
#: A class carries the parities of SKETCH_BITS counters of its shingles, by their low bits.
SKETCH_BITS = 1024
SKETCH = [f"s{k}" for k in range(SKETCH_BITS // 64)]


def _sketch(shingles: np.ndarray) -> np.ndarray:
    """Parities of the numbers of distinct shingles in each counter, as SKETCH_BITS // 64 words."""
    odd = np.bincount((shingles & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _sketch_distance(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    return reduce(Column.__add__, [F.bit_count(a(c).bitwiseXOR(b(c))) for c in SKETCH])


def _sketches_allow(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """If two sets can be similar by their sketches: each parity that differs takes a shingle that only one of them has, and similar
    sets have few of those. It never denies a similar pair."""
    return _sketch_distance(a, b) * (1 + COPY_SIMILARITY) <= (a("n") + b("n")) * (1 - COPY_SIMILARITY) + 1e-6


def _check(votes: int, n: int) -> int:
    """48 bits of the SimHash of n shingles and 16 bits of the logarithm of n."""
    return votes & ~0xFFFF | int(math.log1p(n) * SIZE_STEPS)


def _alike(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    sizes = F.abs(a("check").bitwiseAND(F.lit(0xFFFF)) - b("check").bitwiseAND(F.lit(0xFFFF))) <= -math.log(COPY_SIMILARITY) * SIZE_STEPS + 2
    bits = F.bit_count(F.shiftrightunsigned(a("check").bitwiseXOR(b("check")), 16)) <= SHINGLE_BITS
    return sizes & bits


def _class_id(words: list[bytes]) -> int:
    """The class of a word sequence."""
    return xxhash.xxh64_intdigest(b" ".join(words))


#: Pairs that one task verifies, about, and sets it keeps at hand.
PAIRS_A_TASK, SETS_AT_HAND = 2000, 256


def _verified(pairs: DataFrame, rows: DataFrame, keepers: DataFrame) -> DataFrame:
    """The ``pairs(u, v)`` of classes whose texts have similar sets of shingles: ``rows(row, doc_id, text)`` and, for each class, the
    row that stands for it, ``keepers(id, row)``.

    A sieve of the wanted rows lets few other texts through. Their sets go to files in the shared folder, once each, and pairs carry
    only where their two sets lie: a set takes part in many pairs, so sending it with each would cost more than all texts.
    """
    spark = rows.sparkSession
    ids = pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct()
    wanted = stage(keepers.join(ids, "id").select(F.xxhash64("row.f", "row.i").alias("k")), "wanted")
    found_in, folder = sieve(wanted, "k"), new_path(spark, "shingle-sets")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, wanted_rows = TaskContext.get(), bitmap(found_in)
        name, at = f"part-{context.partitionId():06d}-{context.taskAttemptId()}", 0
        fs, path = file_in(folder, name)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(path, buffer_size=1 << 20) as out:
            for b in batches:
                b = b.filter(pa.array(passes(wanted_rows, b.column(0).to_numpy().view(np.uint64))))
                found = []
                for t in b.column(1).to_pylist():
                    words = _word_list(t)
                    shingles = np.unique(shingle_hashes(words, COPY_SHINGLE))
                    out.write(shingles.astype("<u8").tobytes())
                    found.append((_class_id(words), at, len(shingles)))
                    at += len(shingles)
                cols = np.array(found, np.uint64).reshape(-1, 3).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(cols[:, 0]), pa.array([name] * len(found), pa.string()), pa.array(cols[:, 1]), pa.array(cols[:, 2])], ["id", "file", "at", "n"])

    keyed = rows.select(F.xxhash64("row.f", "row.i").alias("k"), "text")
    # Rows that the sieve let through by chance may repeat a class; one place of each will do.
    with small_batches(spark):
        places = stage(keyed.mapInArrow(write, "id long, file string, at long, n long").groupBy("id").agg(F.min(F.struct("file", "at", "n")).alias("p")), "set-places")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = functools.cache(lambda name: FileRange(folder, name, "<u8"))
        shingles = functools.lru_cache(SETS_AT_HAND)(lambda name, at, n: np.array(files(name)(at, at + n)))
        for b in batches:
            good = []
            for p, q in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                shared = len(np.intersect1d(shingles(*p.values()), shingles(*q.values()), assume_unique=True))
                good.append(shared >= COPY_SIMILARITY * (p["n"] + q["n"] - shared) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(good, pa.bool_())), b.column(1).filter(pa.array(good, pa.bool_()))], ["u", "v"])

    of = lambda c: places.select(F.col("id").alias(c), F.col("p").alias(f"of_{c}"))
    located = stage(pairs.select("u", "v").join(of("u"), "u").join(of("v"), "v").select("u", "v", "of_u", "of_v"), "located-pairs")
    tasks = max(4 * spark.sparkContext.defaultParallelism, located.count() // PAIRS_A_TASK)
    out = stage(located.repartition(tasks).mapInArrow(check, "u long, v long"), "near-links")
    discard(places, wanted, located)
    delete(spark, folder)
    delete(spark, found_in[0])
    return out


def _allowed(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """``(u, v, apart)``: the distinct ``pairs(u, v)`` whose sketches in ``classes(id, n, sketch..)`` allow a link, and how much the
    sketches differ for their size."""
    own = classes.select("id", "n", *SKETCH)
    left, right = _side(own, "a").withColumnRenamed("a_id", "u"), _side(own, "b").withColumnRenamed("b_id", "v")
    met = pairs.distinct().join(left, "u").join(right, "v").where(_sketches_allow(_of("a"), _of("b")))
    return met.select("u", "v", (_sketch_distance(_of("a"), _of("b")) / (_of("a")("n") + _of("b")("n"))).alias("apart"))


def _nearest(pairs: DataFrame) -> DataFrame:
    """Of ``pairs(u, v, apart)``, for each ``v`` the nearest ``u``."""
    return pairs.groupBy("v").agg(F.min_by("u", F.struct("apart", "u")).alias("u")).select("u", "v")


def _between_groups(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """The ``pairs(u, v)`` that ``links`` do not join already."""
    roots = components(links)
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    met = pairs.join(of("u"), "u", "left").join(of("v"), "v", "left")
    return met.where(F.coalesce("root_u", "u") != F.coalesce("root_v", "v")).select("u", "v")


def _star_pairs(classes: DataFrame, fps: list[str]) -> DataFrame:
    """``classes(id, check, fps..)`` to some near pairs ``(u, v)``, of a class and the least one of a bucket: at most one for each
    class, fingerprint and segment. Buckets share a segment and a step of size. A large group fills its buckets, so its members
    meet one of their own there; whatever this round leaves apart, the whole search still compares."""
    step = F.floor(F.col("check").bitwiseAND(F.lit(0xFFFF)) / F.lit(int(-math.log(COPY_SIMILARITY) * SIZE_STEPS)))
    keys = [F.xxhash64(F.lit(c), F.lit(s), step, F.shiftrightunsigned(c, shift).bitwiseAND(F.lit((1 << width) - 1))) for c in fps for s, (shift, width) in enumerate(segments(WORD_BITS))]
    members = classes.select("id", "check", *fps, F.explode(F.array(*keys)).alias("key"))
    least = members.groupBy("key").agg(F.min(F.struct("id", "check", *fps)).alias("c"), F.count("*").alias("n"))
    centres = stage(least.where("n > 1").select("key", "c.*").toDF("key", *(f"a_{c}" for c in ("id", "check", *fps))), "centres")
    a, b = _of("a"), F.col
    near = reduce(Column.__or__, [F.bit_count(a(c).bitwiseXOR(b(c))) <= WORD_BITS for c in fps])
    met = members.join(centres, "key").where((a("id") != b("id")) & near & _alike(a, b))
    return met.select(a("id").alias("u"), b("id").alias("v"))


def _signature_pairs(classes: DataFrame) -> DataFrame:
    """``classes(id, fp)`` to near pairs ``(u, v)`` of their SimHash prints: of a class and the least one of its print, and of the least ones
    of each two prints that differ in COPY_BITS bits at most, all of them, by `hamming_links`."""
    prints = stage(classes.groupBy("fp").agg(F.min("id").alias("u"), F.count("*").alias("n")), "copy-prints")
    same = classes.select("id", "fp").join(prints.where("n > 1"), "fp").where("id <> u").select("u", F.col("id").alias("v"))
    linked = hamming_links(prints.select(F.col("fp").alias("id"), "fp"), COPY_BITS).toDF("a", "b")
    least = lambda end, name: prints.select(F.col("fp").alias(end), F.col("u").alias(name))
    near = linked.join(least("a", "u"), "a").join(least("b", "v"), "b")
    return same.union(near.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")))


def _word_list(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def common_shingles(rows: DataFrame) -> np.ndarray:
    """Hashes of shingles that many texts of ``rows(row, doc_id, text)`` hold, rarest first, at most COMMON_MOST: from a sample. Equal
    texts of a task count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = {b" ".join(_word_list(t)) for t in b.column(0).to_pylist()}
            sets = [np.unique(shingle_hashes(t.split(), COPY_SHINGLE)) for t in texts]
            found, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(found[n > 1].view(np.int64)), pa.array(n[n > 1].astype(np.int64))], ["h", "n"])

    counts = rows.where(F.pmod(F.xxhash64("row"), F.lit(COMMON_SAMPLE)) == 0).select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.col("n").desc(), "h").limit(COMMON_MOST).toArrow()
    return top.column(0).to_numpy()[::-1].view(np.uint64)


def prefix(shingles: np.ndarray, common: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The first shingles of a set (sorted), common ones (sorted, with ranks from 1) last: so many that two sets of similarity
    COPY_SIMILARITY or more share one of these, since each holds that part of the other."""
    n = len(shingles)
    rank = np.zeros(n, np.int64)
    if n and len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        rank = np.where(common[at] == shingles, ranks[at], 0)
    return shingles[np.argsort(rank, kind="stable")[: n - math.ceil(COPY_SIMILARITY * n - 1e-9) + 1]]


def _can_link(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """If two sets can still be similar when the shingle they meet at is the first they share; it is so at one of those they share."""
    return F.least(a("n") - a("pos"), b("n") - b("pos")) * (1 + COPY_SIMILARITY) >= COPY_SIMILARITY * (a("n") + b("n")) - 1e-6


def _hot_index(prints: DataFrame) -> DataFrame:
    """``prints(id, n, prefix)`` to the prefix index ``(key, id, n, pos)``, a row for each class and key, of the keys that several
    classes have. They are found on keys and ids alone; a sieve of them keeps most other rows from being shuffled."""
    keys = prints.select("id", F.explode("prefix").alias("key")).groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    shared = stage(keys.where("lo <> hi").select("key"), "shared-keys")
    found_in = sieve(shared, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        several = bitmap(found_in)
        for b in batches:
            lists = b.column(2)
            keys, sizes = lists.flatten().to_numpy().view(np.uint64), np.diff(lists.offsets.to_numpy())
            who, pos = np.repeat(np.arange(b.num_rows), sizes), np.arange(len(keys)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            keep = np.flatnonzero(passes(several, keys))
            of = pa.array(who[keep])
            yield pa.RecordBatch.from_arrays([pa.array(keys[keep].view(np.int64)), b.column(0).take(of), b.column(1).take(of), pa.array(pos[keep].astype(np.int32))], ["key", "id", "n", "pos"])

    index = prints.select("id", "n", "prefix").mapInArrow(run, "key long, id long, n int, pos int")
    with small_batches(prints.sparkSession):
        hot = stage(index.join(shared, "key", "left_semi").groupBy("key", "id").agg(F.first("n").alias("n"), F.first("pos").alias("pos")), "index")
    discard(shared)
    delete(prints.sparkSession, found_in[0])
    return hot


def _index_stars(index: DataFrame) -> DataFrame:
    """Some pairs ``(u, v)`` that meet in ``index``: of a class and the least, the greatest, or one of two more centres at a key."""
    me = F.struct("id", "n", "pos")
    salted = [F.struct(F.xxhash64("id", F.lit(salt)).alias("h"), me.alias("c")) for salt in (1, 2)]
    ends = [F.min(me), F.max(me), *(F.min(s)["c"] for s in salted)]
    centres = index.groupBy("key").agg(F.array_distinct(F.array(*ends)).alias("cs"))
    met = index.join(centres, "key").select("id", "n", "pos", F.explode("cs").alias("c"))
    a = lambda c: F.col(f"c.{c}")
    return met.where((a("id") != F.col("id")) & _can_link(a, F.col)).select(F.col("c.id").alias("u"), F.col("id").alias("v"))


def _index_pairs(index: DataFrame, classes: DataFrame) -> DataFrame:
    """All pairs ``(u, v)`` of different groups that meet in ``index(key, id, grp, n, pos)`` and can be similar, by their places and by the
    sketches in ``classes``. At each key the largest group stands on one side only, so its members are not compared with each other."""
    sizes = index.groupBy("key", "grp").agg(F.count("*").alias("m"))
    keys = stage(sizes.groupBy("key").agg(F.max(F.struct("m", "grp"))["grp"].alias("major"), F.count("*").alias("groups")).where("groups > 1").select("key", "major"), "open-keys")
    here = stage(index.join(keys, "key").join(classes.select("id", *SKETCH), "id"), "open-index")
    left, right = _side(here.where("grp <> major"), "a"), _side(here, "b")
    a, b = _of("a"), _of("b")
    once = (b("grp") == b("major")) | (a("id") < b("id"))
    met = left.join(right, (a("key") == b("key")) & (a("grp") != b("grp")) & once & _can_link(a, b) & _sketches_allow(a, b))
    out = stage(met.select(F.least(a("id"), b("id")).alias("u"), F.greatest(a("id"), b("id")).alias("v")).distinct(), "near-classes")
    discard(keys, here)
    return out


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with one row of each group of near copies: the one with the smallest id (null last).

    Equal word sequences (A-Z lower-cased) are one class. Classes whose sets of five-word shingles have a Jaccard similarity of 0.8
    or more are linked, all of them, and links join to groups. Texts without a word, null ones included, are one class;
    shorter texts have their whole sequence as the one shingle; of repeated rows one stays. ``docs`` must come from a scan. Empty
    input: no rows.
    """
    keyed, row = with_row_id(docs)
    with merged_joins(docs.sparkSession):
        dropped = _near_copies(keyed.select(F.col(row).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    out = without_rows(keyed, row, dropped)
    discard(dropped)
    return out


def _near_copies(rows: DataFrame) -> DataFrame:
    """The rows that `drop_near_copies` drops of ``rows(row, doc_id, text)``: ``(row)``, staged."""
    spark = rows.sparkSession
    fps = [f"fp{k}" for k in range(len(WORD_SEEDS))]
    often = common_shingles(rows)
    common, ranks = np.sort(often), np.argsort(often) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, firsts, n, sketches = [], [], [], []
            for t in b.column(2).to_pylist():
                words = _word_list(t)
                distinct, shingles = list(set(words)), np.unique(shingle_hashes(words, COPY_SHINGLE))
                own = [_votes(shingle_hashes(distinct, 1, seed)) if words else 0 for seed in WORD_SEEDS]
                votes = _votes(shingles) if words else 0
                out.append((_class_id(words), _check(votes, len(shingles)) if words else 0, votes, *own))
                firsts.append(prefix(shingles, common, ranks).view(np.int64))
                n.append(len(shingles))
                sketches.append(_sketch(shingles))
            cols = np.array(out, np.uint64).reshape(-1, 3 + len(fps)).view(np.int64)
            parities = np.array(sketches, np.int64).reshape(-1, len(SKETCH))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *(pa.array(c) for c in cols.T), pa.array(n, pa.int32()), pa.array(firsts, pa.list_(pa.int64())), *(pa.array(c) for c in parities.T)],
                ["row", "doc_id", "id", "check", "fp", *fps, "n", "prefix", *SKETCH],
            )

    schema = f"row struct<f:bigint,i:bigint>, doc_id long, id long, check long, fp long, {', '.join(f'{c} long' for c in fps)}, n int, prefix array<long>, {', '.join(f'{c} long' for c in SKETCH)}"
    with small_batches(spark):
        prints = stage(rows.mapInArrow(run, schema), "prints")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    classes = stage(prints.groupBy("id").agg(*(F.first(c).alias(c) for c in ("check", "fp", *fps, "n", *SKETCH)), F.min(order).alias("keep")), "classes")

    keepers = classes.select("id", F.col("keep.row").alias("row"))

    def named(df: DataFrame, links: DataFrame, tag: str) -> DataFrame:
        """``df`` with ``grp``, the component of each row's ``id`` under ``links``."""
        roots = components(links)
        out = stage(df.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("grp", F.coalesce("root", "id")).drop("root"), tag)
        discard(roots)
        return out

    # Pairs by SimHash signatures, stars by its buckets and at the prefix index join the bulk of large groups, first each class to its
    # nearest centre; the exact join pairs only what is still apart. Each kind of pairs is a job of its own: one plan of them all runs its
    # many stages at once, and the driver pays for each.
    hot = _hot_index(prints)
    kinds = [stage(_allowed(pairs, classes), "star-pairs") for pairs in (_signature_pairs(classes), _star_pairs(classes, fps), _index_stars(hot))]
    stars = stage(reduce(DataFrame.union, kinds).distinct(), "star-pairs")
    discard(*kinds)
    first = _verified(stage(_nearest(stars), "nearest"), rows, keepers)
    star_links = first.union(_verified(stage(_between_groups(stars, first), "more-stars"), rows, keepers))
    some = named(hot, star_links, "grouped-index")
    near = _index_pairs(some, classes)
    links = star_links.union(_verified(near, rows, keepers))
    groups = named(classes.select("id", "keep"), links, "groups")
    kept = groups.groupBy("grp").agg(F.min("keep").alias("best")).select(F.col("best.row").alias("row"))
    dropped = stage(prints.select("row").join(kept, "row", "left_anti"), "near-copies")
    discard(classes, hot, stars, star_links, some, near, links, groups, prints)
    return dropped
