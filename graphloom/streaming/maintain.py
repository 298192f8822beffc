"""Components kept up to date from a stream of log rows.

Each micro-batch is one set of operations: it is appended to the log, and the components its
edges touch are found anew. Versions of the tables are whole folders, named by the batch, so a
batch that is run again after a failure, by this or another process, writes the same version again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.operators import oplog
from graphloom.schema import OP_LOG


class Maintainer:
    """State under ``path``: ``log/batch=N`` and ``comp/N``. What is done is read from there, so a new Maintainer goes on where another stopped."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def versions(self) -> list[int]:
        """Batches whose components are written whole."""
        fs, at = self._fs(f"{self.path}/comp/*/_SUCCESS")
        return sorted(int(x.getPath().getParent().getName()) for x in fs.globStatus(at) or [])

    @property
    def done(self) -> int:
        return max(self.versions(), default=-1)

    def log(self, upto: int | None = None) -> DataFrame:
        last = self.done if upto is None else upto
        if last < 0:
            return self.spark.createDataFrame([], OP_LOG)
        return self.spark.read.schema(OP_LOG + ", batch long").parquet(f"{self.path}/log").where(F.col("batch") <= last).drop("batch")

    def components(self, number: int | None = None) -> DataFrame:
        number = self.done if number is None else number
        if number < 0:
            return self.spark.createDataFrame([], "vertex_id long, component_id long")
        return self.spark.read.parquet(f"{self.path}/comp/{number}")

    def apply(self, batch: DataFrame, number: int) -> None:
        """One batch. Run again, it starts from the version before and writes the same version again."""
        before = max((v for v in self.versions() if v < number), default=-1)
        batch.select(*[f.split()[0] for f in OP_LOG.split(", ")]).write.mode("overwrite").parquet(f"{self.path}/log/batch={number}")
        log = self.log(number)
        now = log.agg(F.max("seq")).first()[0]
        old = self.components(before)
        if now is not None:
            fresh = log.join(batch.select("seq"), "seq", "left_semi")
            lives = oplog.edge_lives(log)
            ends = fresh.where("op = 'link'").select(F.explode(F.array("u", "v")).alias("vertex_id"))
            cut = fresh.where("op = 'remove_edge'").select("edge_id").join(lives, "edge_id").select(F.explode(F.array("u", "v")).alias("vertex_id"))
            one = fresh.where("op in ('add_vertex', 'remove_vertex')").select(F.col("u").alias("vertex_id"))
            touched = ends.unionByName(cut).unionByName(one).distinct()
            living = lives.where((F.col("born") <= now) & (F.col("dies") > now))
            alive = oplog.vertex_lives(log).where((F.col("born") <= now) & (F.col("dies") > now)).select("vertex_id")
            old = oplog.refresh(old, living, touched).join(alive, "vertex_id", "left_semi")
        old.write.mode("overwrite").parquet(f"{self.path}/comp/{number}")
        for v in self.versions():  # the last two are kept: a batch may run again
            if v < before:
                fs, at = self._fs(f"{self.path}/comp/{v}")
                fs.delete(at, True)

    def run(self, stream: DataFrame, checkpoint: str):
        """Start maintaining from a streaming DataFrame of log rows; returns the query."""
        return stream.writeStream.foreachBatch(lambda df, n: self.apply(df, n)).option("checkpointLocation", checkpoint).start()
