"""Intermediate tables in the cluster's shared folder.

Iterative jobs cut their lineage by writing a table to the folder named by
``spark.checkpoint.dir`` and reading it back. A lost executor then costs the
tasks it ran, never the rounds before, and every executor can read the files.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder, from the session. Only where driver and executors are one process (tests) a temporary one does."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        old = spark.sparkContext._jsc.sc().getCheckpointDir()
        if old.isDefined():
            found = old.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            found = tempfile.mkdtemp(prefix="graphloom-")
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the table read back."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = (path, None)
    return out


def materialize_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """As ``materialize``, bucketed by ``key``: later joins on it do not move this side again."""
    spark = df.sparkSession
    table, path = f"{name}_{uuid.uuid4().hex}", fresh_path(spark, name)
    df.write.bucketBy(buckets, key).format("parquet").option("path", path).saveAsTable(table)
    out = spark.table(table)
    out._scratch = (path, table)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more; other DataFrames are left alone."""
    for df in tables:
        path, table = getattr(df, "_scratch", (None, None))
        if path is None:
            continue
        spark = df.sparkSession
        if table:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        df._scratch = (None, None)


def drop_columns_clash(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Select ``wanted`` columns by position of their first exact-name match, cast to the given types.

    Extra columns, also ones whose names differ only by case or repeat, are left out.
    A wanted column that is missing becomes nulls.
    """
    from pyspark.sql import functions as F

    names = [f"_c{i}" for i in range(len(df.columns))]
    first = {}
    for n, c in zip(names, df.columns):
        first.setdefault(c, n)
    flat = df.toDF(*names)
    return flat.select(*[(F.col(first[c]) if c in first else F.lit(None)).cast(t).alias(c) for c, t in wanted.items()])


def by_position(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns named ``_d0, _d1, ...``, and the new name of the first column of each name: no name can clash."""
    names = [f"_d{i}" for i in range(len(df.columns))]
    first: dict[str, str] = {}
    for n, c in zip(names, df.columns):
        first.setdefault(c, n)
    return df.toDF(*names), first
