"""Aggregates over components and paths, built in or given by the user."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from graphloom.sources.scratch import materialize


def component_fold(comp: DataFrame, edges: DataFrame, labels: DataFrame | None = None, **aggregates: Column) -> DataFrame:
    """``component_id`` and the aggregates over ``weight`` of all its edges and labels; a component without either has no row.

    Rows are folded map-side first, so a component of any size reaches a task as sums.
    """
    rows = edges.join(comp.select(F.col("vertex_id").alias("u"), "component_id"), "u").select("component_id", "weight")
    if labels is not None:
        rows = rows.unionByName(labels.join(comp.select("vertex_id", "component_id"), "vertex_id").select("component_id", "weight"))
    return rows.groupBy("component_id").agg(*[c.alias(n) for n, c in aggregates.items()])


#: The folds of weights shown by name.
NAMED: dict[str, Callable[[str], Column]] = {
    "count": lambda c: F.count(c), "sum": lambda c: F.sum(c), "xor": lambda c: F.bit_xor(c), "max": lambda c: F.max(c), "min": lambda c: F.min(c),
}


@dataclass
class PathAggregate:
    """A user's fold over a path in order: ``init`` for no edge, ``edge`` of an edge's columns, ``merge`` of two parts, left to right.

    All three are column expressions; ``merge`` must be associative and need not commute.
    """

    init: Column
    edge: Callable[[Column], Column]
    merge: Callable[[Column, Column], Column]

    def over(self, steps: DataFrame, edges: DataFrame, name: str = "value") -> DataFrame:
        """``qid, <name>`` for each path."""
        cols = [c for c in edges.columns if c != "edge_id"]
        rows = steps.join(edges, "edge_id").select("qid", F.struct("pos", F.struct("edge_id", *cols).alias("e")).alias("s"))
        got = rows.groupBy("qid").agg(F.array_sort(F.collect_list("s")).alias("path"))
        return got.select("qid", F.aggregate("path", self.init, lambda acc, s: self.merge(acc, self.edge(s["e"]))).alias(name))


def fold_per_component(comp: DataFrame, edges: DataFrame, function, schema: str, most_edges: int = 1_000_000) -> DataFrame:
    """A user's Arrow function over each component's edges in order of ``seq``, for folds that columns cannot express.

    A component over ``most_edges`` edges is refused: it would be one task.
    """
    rows = materialize(edges.join(comp.select(F.col("vertex_id").alias("u"), "component_id"), "u"), "fold")
    most = rows.groupBy("component_id").count().agg(F.max("count")).first()[0] or 0
    if most > most_edges:
        raise ValueError(f"a component has {most} edges, more than {most_edges}: use column aggregates")
    return rows.groupBy("component_id").applyInArrow(function, schema)
