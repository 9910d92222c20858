"""Tables staged in the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, one of our own in local mode, whose
    only machine has it; elsewhere RuntimeError, since executors wouldn't see a folder of the driver."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_dir.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="terrafold-"))


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._staged_path = path
    return back


#: Rows that one task of `spread` takes, about, and tasks for each core.
ROWS_A_TASK, TASKS_A_CORE = 20_000, 4


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly to as many tasks as its rows ask for, at least some for each core. A small file is one task, however much is
    derived from each of its rows. ``df`` is counted first, so it should be a scan of few columns."""
    n = max(TASKS_A_CORE * df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_A_TASK))
    return df.repartition(n)


@contextlib.contextmanager
def shuffled_to(spark: SparkSession, least: int) -> Iterator[None]:
    """While it lasts, shuffles of the session go to ``least`` partitions, or to more if the session says so. What is to be shuffled like
    that must be staged in it."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(max(int(before), least)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextlib.contextmanager
def merged_joins(spark: SparkSession) -> Iterator[None]:
    """While it lasts, the session's joins merge sorted sides unless `broadcast` says otherwise. An estimate is of a table's file, and of one
    row for each row that an explode or a Python function was given, so it may be many times too low; and a job of many small broadcasts
    costs the driver megabytes and a thread for each. What is to be joined like that must be staged in it."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = [spark.conf.get(key, None) for key in keys]
    for key in keys:
        spark.conf.set(key, "-1")
    try:
        yield
    finally:
        for key, value in zip(keys, before):
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing will read any more."""
    for df in tables:
        path = getattr(df, "_staged_path", None)
        if path:
            sc = df.sparkSession.sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
