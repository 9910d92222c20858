"""Sharding over fixed virtual slots and a versioned slot-to-shard map."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, new_path, stage, table

SLOTS = 4096
SHARDS = 16

SlotMap = list[int]


def first_map(slot_bytes: dict[int, int], shards: int = SHARDS, slots: int = SLOTS) -> SlotMap:
    """Version 1: the largest slots first, each to the shard with the fewest bytes so far; empty slots too."""
    out, heap = [0] * slots, [(0, s) for s in range(shards)]
    for slot in sorted(range(slots), key=lambda k: (-slot_bytes.get(k, 0), k)):
        load, s = heapq.heappop(heap)
        out[slot] = s
        heapq.heappush(heap, (load + slot_bytes.get(slot, 0), s))
    return out


def rebalanced(old: SlotMap, slot_bytes: dict[int, int], shards: int) -> SlotMap:
    """The next version for bytes that have changed or shards that have been added: shards above the mean give up slots, smallest
    first, until they fit it; what they gave goes, largest first, to the shards with the fewest bytes. Other slots stay put."""
    new, load = list(old), [0] * shards
    held: list[list[int]] = [[] for _ in range(shards)]
    for slot, s in enumerate(old):
        load[s] += slot_bytes.get(slot, 0)
        held[s].append(slot)
    mean, pool = sum(load) / shards, []
    for s in range(shards):
        for slot in sorted(held[s], key=lambda k: (slot_bytes.get(k, 0), k)):
            if load[s] <= mean:
                break
            load[s] -= slot_bytes.get(slot, 0)
            pool.append(slot)
    heap = [(x, s) for s, x in enumerate(load)]
    heapq.heapify(heap)
    for slot in sorted(pool, key=lambda k: (-slot_bytes.get(k, 0), k)):
        x, s = heapq.heappop(heap)
        new[slot] = s
        heapq.heappush(heap, (x + slot_bytes.get(slot, 0), s))
    return new


def with_slots(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """Adds ``tf_size`` (UTF-8 bytes of the text, null as none, plus 1) and ``tf_slot``, from the id and the text, so that a
    repeated id doesn't fill one slot."""
    size = (F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) + 1).cast("long")
    slot = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(slots)).cast("int")
    return docs.withColumn("tf_size", size).withColumn("tf_slot", slot)


def slot_totals(slotted: DataFrame) -> DataFrame:
    """Rows and bytes of each slot: at most as many rows as there are slots."""
    return slotted.groupBy("tf_slot").agg(F.count("*").alias("n"), F.sum("tf_size").alias("bytes"))


def map_table(spark: SparkSession, versions: list[SlotMap]) -> DataFrame:
    """``(version, tf_slot, shard)``: every version of the map, from 1; rows of versions times slots, whatever the data."""
    rows = [(v, slot, s) for v, m in enumerate(versions, 1) for slot, s in enumerate(m)]
    return spark.createDataFrame(rows, "version int, tf_slot int, shard int")


def save_maps(spark: SparkSession, versions: list[SlotMap], folder: str) -> None:
    """Stores the table of `map_table` as Parquet, a partition for each version; versions that are there stay as they are."""
    map_table(spark, versions).write.mode("ignore").partitionBy("version").parquet(folder)


def add_map(spark: SparkSession, folder: str, slot_bytes: dict[int, int], shards: int) -> int:
    """Rebalances the newest stored map, stores the result as the next version and returns its number."""
    last, current = read_map(spark, folder)
    new = map_table(spark, [rebalanced(current, slot_bytes, shards)]).withColumn("version", F.lit(last + 1))
    new.write.mode("append").partitionBy("version").parquet(folder)
    return last + 1


def read_map(spark: SparkSession, folder: str, version: int | None = None) -> tuple[int, SlotMap]:
    """A stored map, the newest if no version is named: its number and the shard of each slot."""
    stored = spark.read.schema("tf_slot int, shard int, version int").parquet(folder)
    at = version or stored.agg(F.max("version").alias("v")).first().v
    rows = stored.where(F.col("version") == at).select("tf_slot", "shard").collect()
    return at, [r.shard for r in sorted(rows, key=lambda r: r.tf_slot)]


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, slots: int = SLOTS, maps: str | None = None) -> DataFrame:
    """One row for each input row: ``doc_id, size, text_crc32, shard, slot`` (place in the shard, gapless from 0), ``virtual_slot``,
    ``map_version``.

    Bytes of the fixed virtual slots, at most ``slots`` sums, decide the map, which is stored under ``maps`` (by default a new folder in
    the shared one) and read back. Places are counted within a virtual slot and moved by
    the rows of the shard's slots before it. Null texts count one byte and have the CRC of nothing; null ids are hashed like any
    other; repeated rows stay. Empty input: no rows.
    """
    spark = docs.sparkSession
    narrow = with_slots(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text", slots)
    rows = stage(narrow.select("doc_id", F.col("tf_size").alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), "tf_size", "tf_slot"), "shard-rows")
    totals = {r.tf_slot: (r.n, r.bytes) for r in slot_totals(rows).collect()}
    maps = maps or new_path(spark, "slot-map")
    save_maps(spark, [first_map({k: b for k, (_, b) in totals.items()}, shards, slots)], maps)
    version, now = read_map(spark, maps)
    before, offset = [0] * shards, []
    for slot, s in enumerate(now):
        offset.append(before[s])
        before[s] += totals.get(slot, (0, 0))[0]
    places = spark.createDataFrame([(slot, s, offset[slot], version) for slot, s in enumerate(now)], "tf_slot int, shard int, offset long, version int")
    own = Window.partitionBy("tf_slot").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    return (
        rows.withColumn("k", F.row_number().over(own)).join(F.broadcast(places), "tf_slot")
        .select("doc_id", "size", "text_crc32", "shard", (F.col("k") - 1 + F.col("offset")).cast("long").alias("slot"), F.col("tf_slot").alias("virtual_slot"), F.col("version").alias("map_version"))
    )


def sharded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, slots: int = SLOTS, maps: str | None = None) -> DataFrame:
    """``docs``, all columns, with ``virtual_slot``, ``shard`` and ``map_version`` (under longer names where those are taken): a column
    computed in place and a join with the broadcast map; rows don't move. Edge cases as in `shard_documents`."""
    spark = docs.sparkSession
    own = with_slots(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text", slots)
    maps = maps or new_path(spark, "slot-map")
    save_maps(spark, [first_map({r.tf_slot: r.bytes for r in slot_totals(own).collect()}, shards, slots)], maps)
    number, now = read_map(spark, maps)
    virtual, shard, version = (fresh(docs, name) for name in ("virtual_slot", "shard", "map_version"))
    current = spark.createDataFrame([(slot, s, number) for slot, s in enumerate(now)], f"`{virtual}` int, `{shard}` int, `{version}` int")
    slot = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(slots)).cast("int")
    return docs.withColumn(virtual, slot).join(F.broadcast(current), virtual).select(*docs.columns, virtual, shard, version)


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    """Contract: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    out = shard_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
