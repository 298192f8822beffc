"""An undirected multigraph in two tables, with scans, lookups and set-style changes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from graphloom.schema import EDGES, VERTICES, split_self_loops
from graphloom.sources.scratch import materialize


#: Bytes of input files for each piece of a range sort.
PIECE = 32_000_000


def pieces(rows: DataFrame) -> int:
    """Pieces for a range sort: as many as shuffles have, more where the files behind ``rows`` are large, so that a task's part stays the same."""
    leaves = rows._jdf.queryExecution().analyzed().collectLeaves()
    size = sum(x for x in (int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())) if x < 2**60)
    return min(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // PIECE), 20_000)


def with_sequence(rows: DataFrame, *order: str, name: str = "edge_id") -> DataFrame:
    """Number rows 1.. in the given order: a range sort whose parts are written with the places in them, a count a part, then offsets as a constant. No task sees all rows."""
    n = pieces(rows)
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    dealt = materialize(dealt, "ranges")
    part = F.shiftright("_m", 33).cast("int")
    before, total = [1] * n, 1
    for p, k in sorted(dealt.groupBy(part.alias("p")).count().collect()):  # a row a part
        before[p], total = total, total + k
    starts = F.expr(f"array({', '.join(f'{x}L' for x in before)})")
    return dealt.select(*rows.columns, (F.col("_m").bitwiseAND(2**33 - 1) + starts[part]).alias(name))


def running_sums(rows: DataFrame, order: list[str], values: dict[str, str]) -> DataFrame:
    """``rows`` with ``run_<c>`` for each column of ``values``: its sum (``sum``) or exclusive or (``xor``) over this and all rows before, in the given order.

    A range sort, running values inside each partition and offsets from the partitions before; no task sees all rows.
    """
    dealt = materialize(rows.repartitionByRange(pieces(rows), *order).withColumn("_p", F.spark_partition_id()), "ranges")
    fold = {"sum": F.sum, "xor": F.bit_xor}
    whole = dealt.groupBy("_p").agg(*[fold[k](c).alias(f"_{c}") for c, k in values.items()])
    ahead = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    before = whole.select("_p", *[F.coalesce(fold[k](f"_{c}").over(ahead), F.lit(0)).alias(f"_b_{c}") for c, k in values.items()])
    own = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.select("*", *[fold[k](c).over(own).alias(f"_o_{c}") for c, k in values.items()]).join(F.broadcast(before), "_p")
    run = [((F.col(f"_o_{c}") + F.col(f"_b_{c}")) if k == "sum" else F.col(f"_o_{c}").bitwiseXOR(F.col(f"_b_{c}"))).alias(f"run_{c}") for c, k in values.items()]
    return out.select(*rows.columns, *run)


@dataclass
class Graph:
    """``vertices(vertex_id)`` and ``edges(edge_id, u, v, weight, seq)``; parallel edges are edges of their own."""

    vertices: DataFrame
    edges: DataFrame
    #: ``u, v`` with all vertices as ends, self-loops too, and no other links than the edges; where it is not given, it is made of both.
    links: DataFrame | None = None

    @classmethod
    def empty(cls, spark: SparkSession) -> Graph:
        return cls(spark.createDataFrame([], VERTICES), spark.createDataFrame([], EDGES))

    @classmethod
    def of_edges(cls, edges: DataFrame, vertices: DataFrame | None = None) -> Graph:
        """Self-loops are rejected but keep their vertex; edges without weight or seq take 1 and their id."""
        for c, x in (("weight", F.lit(1)), ("seq", F.col("edge_id"))):
            if c not in edges.columns:
                edges = edges.withColumn(c, x)
        edges = edges.select(*[F.col(c).cast("long").alias(c) for c in ("edge_id", "u", "v", "weight", "seq")])
        ends = edges.select(F.explode(F.array("u", "v")).alias("vertex_id"))
        links = edges.select("u", "v")
        if vertices is not None:
            more = vertices.select(F.col("vertex_id").cast("long").alias("vertex_id"))
            ends, links = ends.unionByName(more), links.unionByName(more.select(F.col("vertex_id").alias("u"), F.col("vertex_id").alias("v")))
        return cls(ends.distinct(), split_self_loops(edges)[0], links)

    # scans and lookups
    def symmetric(self) -> DataFrame:
        """Each edge from both ends: ``vertex_id, other, edge_id, weight``."""
        e = self.edges
        return e.select(F.col("u").alias("vertex_id"), F.col("v").alias("other"), "edge_id", "weight").unionByName(e.select(F.col("v").alias("vertex_id"), F.col("u").alias("other"), "edge_id", "weight"))

    def endpoints(self, ids: DataFrame) -> DataFrame:
        """``edge_id, u, v``; nulls for an edge that does not live."""
        return ids.select("edge_id").join(self.edges.select("edge_id", "u", "v"), "edge_id", "left")

    def degree(self, labels: DataFrame | None = None) -> DataFrame:
        """``vertex_id, degree``: edges and, if given, labels at each vertex; 0 for isolated ones."""
        at = self.symmetric().select("vertex_id")
        if labels is not None:
            at = at.unionByName(labels.select("vertex_id"))
        n = at.groupBy("vertex_id").agg(F.count("*").alias("degree"))
        return self.vertices.join(n, "vertex_id", "left").select("vertex_id", F.coalesce("degree", F.lit(0)).alias("degree"))

    def multiplicity(self) -> DataFrame:
        """``u, v, copies, edge_ids`` by unordered pair."""
        return self.edges.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.count("*").alias("copies"), F.sort_array(F.collect_list("edge_id")).alias("edge_ids"))

    def find_edges(self, pairs: DataFrame, cover: DataFrame | None = None) -> DataFrame:
        """``u, v, edge_id`` for unordered pairs: a tree edge first, else the smallest level (of a column ``level`` of ``cover``, if it has one) and id; null if none."""
        e = self.edges.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "edge_id")
        rank: list[Column] = [F.col("edge_id")]
        if cover is not None:
            level = F.when(F.col("is_tree"), 0).otherwise(F.col("level") if "level" in cover.columns else 0)
            e = e.join(cover.select("edge_id", "is_tree", level.alias("level")), "edge_id")
            rank = [(~F.col("is_tree")).alias("t"), F.col("level"), F.col("edge_id")]
        best = e.groupBy("a", "b").agg(F.min(F.struct(*rank)).alias("m")).select("a", "b", F.col("m.edge_id").alias("edge_id"))
        asked = pairs.select("u", "v", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
        return asked.join(best, ["a", "b"], "left").select("u", "v", "edge_id")

    # changes
    def add_vertices(self, vertices: DataFrame) -> Graph:
        return Graph(self.vertices.unionByName(vertices.select("vertex_id")).distinct(), self.edges)

    def link(self, edges: DataFrame) -> Graph:
        """New edges between living vertices; self-loops and edges to others are refused."""
        new = split_self_loops(edges.select(*self.edges.columns))[0]
        for end in ("u", "v"):
            new = new.join(self.vertices.withColumnRenamed("vertex_id", end), end, "left_semi")
        return Graph(self.vertices, self.edges.unionByName(new.select(*self.edges.columns)))

    def remove_edges(self, ids: DataFrame) -> Graph:
        return Graph(self.vertices, self.edges.join(ids.select("edge_id"), "edge_id", "left_anti"))

    def cut(self, pairs: DataFrame) -> Graph:
        """Removes all edges of the given unordered pairs; a pair without edge changes nothing."""
        p = pairs.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
        e = self.edges.withColumn("a", F.least("u", "v")).withColumn("b", F.greatest("u", "v"))
        return Graph(self.vertices, e.join(p, ["a", "b"], "left_anti").select(*self.edges.columns))

    def cut_edges(self, pairs: DataFrame) -> DataFrame:
        """The edges that ``cut`` removes, with their payload."""
        p = pairs.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
        return self.edges.withColumn("a", F.least("u", "v")).withColumn("b", F.greatest("u", "v")).join(p, ["a", "b"], "left_semi").select(*self.edges.columns)

    def isolated(self, ids: DataFrame) -> DataFrame:
        """``vertex_id, is_there, is_isolated`` of the vertices asked for."""
        d = self.degree().select("vertex_id", "degree")
        return ids.select("vertex_id").distinct().join(d, "vertex_id", "left").select("vertex_id", F.col("degree").isNotNull().alias("is_there"), F.coalesce(F.col("degree") == 0, F.lit(False)).alias("is_isolated"))

    def remove_isolated_vertices(self, ids: DataFrame) -> tuple[Graph, DataFrame]:
        """Removes vertices without edges; and ``vertex_id`` of those refused, which have edges or are not there."""
        asked = materialize(self.isolated(ids), "isolated")
        return Graph(self.vertices.join(asked.where("is_isolated").select("vertex_id"), "vertex_id", "left_anti"), self.edges), asked.where("not is_isolated").select("vertex_id")

    def remove_vertices(self, ids: DataFrame) -> Graph:
        """Removes vertices with all their edges."""
        gone = ids.select("vertex_id")
        left = self.edges
        for end in ("u", "v"):
            left = left.join(gone.withColumnRenamed("vertex_id", end), end, "left_anti")
        return Graph(self.vertices.join(gone, "vertex_id", "left_anti"), left.select(*self.edges.columns))
