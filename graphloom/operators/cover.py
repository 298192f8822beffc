"""Cover levels of forest edges under an ordered log of path updates, and path additions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from graphloom.operators.paths import path_folds, subtree_sums
from graphloom.schema import MIN_LEVEL, NO_COVER


def cover_to(x: Column, level: Column) -> Column:
    """Cover: raises to the level; ``NO_COVER`` stays."""
    return F.greatest(x, level)


def uncover_to(x: Column, level: Column) -> Column:
    """Uncover: covers up to the level go back to -1."""
    return F.when((x <= level) & (x != NO_COVER), F.lit(MIN_LEVEL)).otherwise(x)


def tag(op: Column, level: Column) -> Column:
    """An update as the pair (t, c): x becomes c where x <= t. Cover l is (l, l), uncover l is (l, -1); levels under -1 count as -1."""
    l = F.greatest(level, F.lit(MIN_LEVEL))
    return F.struct(l.alias("t"), F.when(op == "cover", l).otherwise(F.lit(MIN_LEVEL)).alias("c"))


def apply_tag(x: Column, t: Column) -> Column:
    return F.when((x > t["t"]) | (x == NO_COVER), x).otherwise(t["c"])


def compose(first: Column, then: Column) -> Column:
    """The one tag that does what ``first`` and then ``then`` do."""
    return F.struct(F.greatest(first["t"], F.when(first["c"] <= then["t"], then["t"]).otherwise(first["t"])).alias("t"), apply_tag(first["c"], then).alias("c"))


def fold_tags(edges: DataFrame, ops: DataFrame, steps: DataFrame) -> DataFrame:
    """``edge_id, cover_level`` of forest edges, -1 at first, after all updates ``seq, op, level`` in order along their paths.

    ``steps`` are the paths of the updates, ``qid`` being their ``seq``.
    """
    at = steps.select(F.col("qid").alias("seq"), "edge_id").join(ops.select("seq", "op", "level"), "seq")
    one = at.select("edge_id", F.struct("seq", tag(F.col("op"), F.col("level")).alias("tag")).alias("s")).groupBy("edge_id").agg(F.array_sort(F.collect_list("s")).alias("log"))
    done = one.select("edge_id", F.aggregate("log", F.lit(MIN_LEVEL), lambda x, s: apply_tag(x, s["tag"]).cast("int")).alias("cover_level"))
    return edges.select("edge_id").join(done, "edge_id", "left").select("edge_id", F.coalesce("cover_level", F.lit(MIN_LEVEL)).alias("cover_level"))


def add_on_paths(forest: DataFrame, edges: DataFrame, ops: DataFrame) -> DataFrame:
    """``edge_id, weight`` of forest edges after adding ``x`` of each ``seq, u, v, x`` to every edge of its path.

    An update marks its ends with x and their lowest common ancestor with -2x; an edge gains the sum
    of the marks below it. No path is written out.
    """
    top = path_folds(forest, ops.select(F.col("seq").alias("qid"), "u", "v")).select(F.col("qid").alias("seq"), "lca")
    marks = ops.join(top, "seq").select(F.explode(F.array(F.struct(F.col("u").alias("vertex_id"), F.col("x").cast("long").alias("x")), F.struct(F.col("v").alias("vertex_id"), F.col("x").cast("long").alias("x")), F.struct(F.col("lca").alias("vertex_id"), (-2 * F.col("x")).cast("long").alias("x")))).alias("m")).select("m.*")
    plus = subtree_sums(forest, marks.groupBy("vertex_id").agg(F.sum("x").alias("x")), "x")
    below = forest.where("parent is not null").select("vertex_id", F.col("parent_edge").alias("edge_id")).join(plus, "vertex_id")
    return edges.join(below, "edge_id", "left").select("edge_id", (F.col("weight") + F.coalesce("total", F.lit(0))).alias("weight"))


def identity_tag() -> Column:
    """The tag that changes nothing: x becomes -1 where x <= -1."""
    return F.struct(F.lit(MIN_LEVEL).alias("t"), F.lit(MIN_LEVEL).alias("c"))


def size_vector_sum(sizes: DataFrame, *keys: str) -> DataFrame:
    """Sums of size vectors in long form (a row a level; zero entries have no row)."""
    return sizes.groupBy(*keys, "level").agg(F.sum("size").alias("size")).where("size <> 0")


def part_entries(sizes: DataFrame, masks: DataFrame, *keys: str) -> DataFrame:
    """The monoid of parts by ``keys``: size vectors summed as a map of levels, masks joined by or. ``sizes``: keys, level, size; ``masks``: keys, mask."""
    a = size_vector_sum(sizes, *keys).groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("level", "size")))).alias("sizes"))
    b = masks.groupBy(*keys).agg(F.bit_or("mask").alias("mask"))
    return a.join(b, list(keys), "full_outer").select(*keys, "sizes", F.coalesce("mask", F.lit(0)).alias("mask"))


def masked(sizes: DataFrame, level: int) -> DataFrame:
    """The entries of levels up to ``level``."""
    return sizes.where(F.col("level") <= level)
