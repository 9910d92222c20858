"""Corpus pipeline: quality rules, near copies, decontamination, mixing, sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrafold.llm.common import stage, table
from terrafold.llm.decontam import drop_leaks
from terrafold.llm.mixing import mixed_documents
from terrafold.llm.quality import drop_low_quality
from terrafold.llm.sharding import sharded
from terrafold.llm.simhash import drop_near_copies

#: (name, function of the session, the documents so far and the data folder); each is written and read again before the next.
STAGES = [
    ("quality", lambda spark, docs, sf_dir: drop_low_quality(docs)),
    ("near_copies", lambda spark, docs, sf_dir: drop_near_copies(docs)),
    ("decontamination", lambda spark, docs, sf_dir: drop_leaks(docs, table(spark, sf_dir, "benchmark"))),
    ("mixing", lambda spark, docs, sf_dir: mixed_documents(docs)),
    ("sharding", lambda spark, docs, sf_dir: sharded(docs)),
]

#: SimHash and XXH64 have no counterpart in the SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``: its columns, ``virtual_slot``, ``shard`` and ``map_version``.

    Null and empty texts go with the quality rules, near copies and repeated rows go but one, null ids come last among them; the mix
    may take a row several times. Rows without language or source stay. Long texts are read whole. Other columns are kept, whatever
    their names. An empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
