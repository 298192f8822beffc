"""Settings of the session that bound memory and disk, whatever a row or a plan is like."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes of the batches that go to Python workers; a longer row is a batch of its own.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Shuffle files go when the query that made them has ended; what is read again is a table.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Scratch tables of numbers take many times their files' bytes in memory; by the files alone, tables of millions of rows are broadcast.
FACTOR = "spark.sql.sources.fileCompressionFactor"
#: Partitions that a shuffle starts with, before small ones are put together.
FIRST = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
#: Bytes of tables for each of these.
PART = 8_000_000

_ours: set[str] = set()


def bound_tasks(spark: SparkSession, size: int) -> None:
    """Queries over graphs of ``size`` bytes of tables: broadcasts of up to about 30 MB in memory and shuffle partitions that do not grow with the tables, until the next ``prepare``."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for key, value in ((FACTOR, "8.0"), (FIRST, str(max(least, min(size // PART, 10_000))))):
        if key in _ours or spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
            _ours.add(key)


def prepare(spark: SparkSession) -> SparkSession:
    """Batches of 2 MB and no shuffle files of ended queries, where the session does not say otherwise."""
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, "2m")
    if not spark.sparkContext.getConf().contains(CLEANUP):
        spark.conf.set(CLEANUP, "true")
    while _ours:
        spark.conf.unset(_ours.pop())
    return spark
