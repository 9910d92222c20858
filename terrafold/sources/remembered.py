"""What outlives a run: profiles of folders under a fingerprint, what was declared by hand, overrides of matches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Raised when profiles are made otherwise, so that stored ones no longer count.
PROFILE_VERSION = 6
OVERRIDES = "coarse string, fine string, shape_id long, matched string, at long"


def fingerprint(spark: SparkSession, folder: str) -> str:
    """A digest of the names and sizes of all files under a folder; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    told = sorted((r.path.removeprefix(folder), r.length) for r in files.collect())
    return hashlib.sha256(repr(told).encode()).hexdigest()[:24]


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def cached_profile(spark: SparkSession, folder: str, store: str, build: Callable[[str], DataFrame], rebuild: bool = False, version: int = PROFILE_VERSION) -> DataFrame:
    """``build(folder)``, stored under the folder's fingerprint and the version: as long as no file comes, goes or changes its size, later
    calls read the stored rows and none of the files. ``rebuild`` makes it anew. Profiles of other states stay beside it."""
    path = f"{store.rstrip('/')}/profile-{fingerprint(spark, folder)}-v{version}"
    if rebuild or not _exists(spark, f"{path}/_SUCCESS"):
        build(folder).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def declare(spark: SparkSession, store: str, rows: DataFrame) -> None:
    """Adds ``rows(key, value, at)`` that somebody wrote by hand; they lie beside the profiles, so no rebuilding touches them."""
    rows.select("key", "value", "at").write.mode("append").parquet(f"{store.rstrip('/')}/declared")


def declared(spark: SparkSession, store: str) -> DataFrame:
    """``(key, value)``: what was declared last under each key; none without a store."""
    path, schema = f"{store.rstrip('/')}/declared", "key string, value string, at long"
    rows = spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)
    return rows.groupBy("key").agg(F.max_by("value", F.struct("at", "value")).alias("value"))


def store_overrides(rows: DataFrame, store: str) -> None:
    """Adds ``rows(coarse, fine, shape_id, matched, at)``: which unit a name stands for, as somebody decided. Names are kept in lower case;
    earlier decisions stay in the store."""
    lower = [F.lower(F.trim(c)).alias(c) for c in ("coarse", "fine")]
    rows.select(*lower, F.col("shape_id").cast("long").alias("shape_id"), "matched", F.col("at").cast("long").alias("at")).write.mode("append").parquet(store)


def stored_overrides(spark: SparkSession, store: str) -> DataFrame:
    """``(coarse, fine, shape_id, matched)`` for `review_nested`: the last decision for each pair of names; a decision without a unit takes
    the earlier ones back. None without a store."""
    rows = spark.read.schema(OVERRIDES).parquet(store) if _exists(spark, store) else spark.createDataFrame([], OVERRIDES)
    last = rows.groupBy("coarse", "fine").agg(F.max_by(F.struct("shape_id", "matched"), F.struct("at", "shape_id", "matched")).alias("d"))
    return last.select("coarse", "fine", "d.shape_id", "d.matched").where("shape_id is not null")
