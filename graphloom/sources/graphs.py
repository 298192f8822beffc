"""Graphs held in the driver's relational tables, and reading and writing of graph tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.operators.graph import Graph, with_sequence
from graphloom.operators.structure import Structure, derive
from graphloom.sources.scratch import materialize
from graphloom.sources.session import bound_tasks

_kept: dict[tuple, Structure] = {}


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/lineitem.parquet").withColumn("eid", F.col("l_orderkey") * 10 + F.col("l_linenumber"))


def customer_part(spark: SparkSession, sf: str) -> DataFrame:
    """Customers and the parts of all lines of their orders."""
    o, l = spark.read.parquet(f"{sf}/orders.parquet"), _lines(spark, sf)
    j = l.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select("eid", (2 * F.col("o_custkey")).alias("u"), (2 * F.col("l_partkey") + 1).alias("v"), F.col("l_quantity").cast("long").alias("weight"))


def part_supplier(spark: SparkSession, sf: str) -> DataFrame:
    """Parts and suppliers of all lines; many pairs have several."""
    return _lines(spark, sf).select("eid", (2 * F.col("l_partkey")).alias("u"), (2 * F.col("l_suppkey") + 1).alias("v"), F.col("l_linenumber").cast("long").alias("weight"))


def order_part(spark: SparkSession, sf: str) -> DataFrame:
    """Orders and the parts of all their lines; an order of one line hangs on a bridge."""
    return _lines(spark, sf).select("eid", (2 * F.col("l_orderkey")).alias("u"), (2 * F.col("l_partkey") + 1).alias("v"), F.col("l_linenumber").cast("long").alias("weight"))


def hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    """The forest region - nation - customer; ids start at 1, 2 and 3 times 10^12, an edge has the id of its lower end."""
    n, c = spark.read.parquet(f"{sf}/nation.parquet"), spark.read.parquet(f"{sf}/customer.parquet")
    base = 10**12
    up = n.select((F.col("n_nationkey") + 2 * base).alias("u"), (F.col("n_regionkey") + base).alias("v"), (F.col("n_nationkey") + 1).alias("weight"))
    down = c.select((F.col("c_custkey") + 3 * base).alias("u"), (F.col("c_nationkey") + 2 * base).alias("v"), (F.col("c_custkey") % 97 + 1).alias("weight"))
    return up.unionByName(down).select(F.col("u").cast("long").alias("edge_id"), F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), F.col("weight").cast("long").alias("weight"))


def graph(spark: SparkSession, sf: str, name: str) -> Graph:
    bound_tasks(spark, sum(x[1] for x in _stamp(spark, sf)))
    if name == "hierarchy":
        return Graph.of_edges(materialize(hierarchy(spark, sf), "hierarchy"))
    rows = {"customer_part": customer_part, "part_supplier": part_supplier, "order_part": order_part}[name](spark, sf)
    return Graph.of_edges(with_sequence(rows, "eid", "u", "v", "weight").drop("eid"))


def _stamp(spark: SparkSession, sf: str) -> tuple:
    """Paths, lengths and times of the tables' files: other data, other stamp."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sf)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [x for n in ("lineitem", "orders", "nation", "region", "customer") for x in (fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf}/{n}.parquet")) or [])]
    return tuple(sorted((x.getPath().toString(), x.getLen(), x.getModificationTime()) for x in found))


def structure(spark: SparkSession, sf: str, name: str) -> Structure:
    """Derived tables of a graph; they are written once and read again by later queries of the session on the same files."""
    stamp = _stamp(spark, sf)
    bound_tasks(spark, sum(x[1] for x in stamp))
    key = (spark.sparkContext.applicationId, sf, name, stamp)
    if key not in _kept:
        _kept[key] = derive(graph(spark, sf, name), stored=True)
    return _kept[key]


def forget() -> None:
    """Later queries derive their graphs anew."""
    _kept.clear()


def write(g: Graph, path: str) -> None:
    g.vertices.write.mode("overwrite").parquet(f"{path}/vertices")
    g.edges.write.mode("overwrite").parquet(f"{path}/edges")


def read(spark: SparkSession, path: str) -> Graph:
    return Graph(spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges"))
