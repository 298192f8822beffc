"""Labels: leaves that hang on a vertex, ``label_id, vertex_id, level, weight``, none or many a vertex."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from graphloom.operators.graph import Graph, with_sequence
from graphloom.sources.scratch import materialize

COLUMNS = ("label_id", "vertex_id", "level", "weight")


def attach(g: Graph, labels: DataFrame, new: DataFrame) -> DataFrame:
    """Labels with new ones at living vertices; one at another vertex, or of an id in use, is refused."""
    ok = new.join(g.vertices, "vertex_id", "left_semi").join(labels.select("label_id"), "label_id", "left_anti")
    return labels.select(*COLUMNS).unionByName(ok.select(*COLUMNS))


def detach(labels: DataFrame, ids: DataFrame) -> DataFrame:
    return labels.join(ids.select("label_id"), "label_id", "left_anti")


def update_label(labels: DataFrame, new: DataFrame) -> DataFrame:
    """Weights replaced by those of ``new`` (``label_id, weight``); an id that is no label is ignored."""
    w = new.select("label_id", F.col("weight").alias("_w"), F.lit(True).alias("_h"))
    return labels.join(w, "label_id", "left").select("label_id", "vertex_id", "level", F.when(F.col("_h"), F.col("_w")).otherwise(F.col("weight")).alias("weight"))


def replay(log: DataFrame, g: Graph | None = None) -> DataFrame:
    """Labels after a log ``seq, op, label_id, vertex_id, level, weight`` of attach, update_label and detach. Ids are not used again.

    A label lives from its first attach to its first detach after that; its weight is that of the
    last attach or update while it lives.
    """
    born = log.where("op = 'attach'").groupBy("label_id").agg(F.min(F.struct("seq", "vertex_id", "level", "weight")).alias("b"))
    at = log.join(born, "label_id").where(F.col("seq") > F.col("b.seq"))
    rest = at.groupBy("label_id").agg(F.min(F.when(F.col("op") == "detach", F.col("seq"))).alias("gone"), F.max_by("weight", F.when(F.col("op") == "update_label", F.col("seq"))).alias("w"), F.max(F.when(F.col("op") == "update_label", F.lit(True))).alias("h"))
    out = born.join(rest, "label_id", "left").where("gone is null").select("label_id", "b.vertex_id", "b.level", F.when(F.col("h"), F.col("w")).otherwise(F.col("b.weight")).alias("weight"))
    return out if g is None else out.join(g.vertices, "vertex_id", "left_semi").select(*COLUMNS)


def label_vertex(labels: DataFrame, ids: DataFrame) -> DataFrame:
    """``label_id, vertex_id``; null for an id that is no label."""
    return ids.select("label_id").join(labels.select("label_id", "vertex_id"), "label_id", "left")


def first_label(labels: DataFrame, vertices: DataFrame) -> DataFrame:
    """``vertex_id, label_id``: the smallest label at each vertex; null for none."""
    return vertices.select("vertex_id").join(labels.groupBy("vertex_id").agg(F.min("label_id").alias("label_id")), "vertex_id", "left")


def into_vertex(labels: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, vertex_id`` for ids of labels or vertices: a label stands for its vertex, any other id for itself."""
    return ids.select("id").join(labels.select(F.col("label_id").alias("id"), "vertex_id"), "id", "left").select("id", F.coalesce("vertex_id", "id").alias("vertex_id"))


def leaves(g: Graph, labels: DataFrame) -> DataFrame:
    """``kind, leaf_id, vertex_id, other, weight``: all edges and labels as one table; ``other`` is null for labels."""
    e = g.edges.select(F.lit("edge").alias("kind"), F.col("edge_id").alias("leaf_id"), F.col("u").alias("vertex_id"), F.col("v").alias("other"), "weight")
    return e.unionByName(labels.select(F.lit("label").alias("kind"), F.col("label_id").alias("leaf_id"), "vertex_id", F.lit(None).cast("long").alias("other"), "weight"))


def payloads(leaves: DataFrame) -> DataFrame:
    """``kind, leaf_id, edge_weight, label_weight``: the weight in the column of its kind, null in the other."""
    return leaves.select("kind", "leaf_id", *[F.when(F.col("kind") == k, F.col("weight")).alias(f"{k}_weight") for k in ("edge", "label")])


def incident_leaves(g: Graph, labels: DataFrame) -> DataFrame:
    """``vertex_id, kind, leaf_id, weight``: every edge at both its ends and every label at its vertex."""
    e = g.symmetric().select("vertex_id", F.lit("edge").alias("kind"), F.col("edge_id").alias("leaf_id"), "weight")
    return e.unionByName(labels.select("vertex_id", F.lit("label").alias("kind"), F.col("label_id").alias("leaf_id"), "weight"))


def leaf_ranges(comp: DataFrame, leaves: DataFrame) -> DataFrame:
    """``component_id, kind, leaf_id, place, place_from_end``: the leaves of each component in order (edges, then labels, by id), counted from 0 from both ends.

    A numbering of all leaves by (component, kind, id), less each component's first: a component of
    any size is never one task.
    """
    at = leaves.join(comp.select("vertex_id", "component_id"), "vertex_id").select("component_id", "kind", "leaf_id")
    k = materialize(with_sequence(at, "component_id", "kind", "leaf_id", name="k"), "leaves")
    ends = k.groupBy("component_id").agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
    return k.join(ends, "component_id").select("component_id", "kind", "leaf_id", (F.col("k") - F.col("lo")).alias("place"), (F.col("hi") - F.col("k")).alias("place_from_end"))


def degrees(g: Graph, labels: DataFrame, n: int = 2) -> DataFrame:
    """``vertex_id, degree, is_boundary, is_degree_leq_two, is_at_least_n, is_exactly_n``: edges and labels at each vertex; two or more make a boundary vertex."""
    d = g.degree(labels)
    return d.select("vertex_id", "degree", (F.col("degree") >= 2).alias("is_boundary"), (F.col("degree") <= 2).alias("is_degree_leq_two"), (F.col("degree") >= n).alias("is_at_least_n"), (F.col("degree") == n).alias("is_exactly_n"))


def counts(g: Graph, labels: DataFrame) -> DataFrame:
    """One row: ``vertices, edges, labels``."""
    one = lambda df, n: df.agg(F.count("*").alias(n))
    return one(g.vertices, "vertices").crossJoin(one(g.edges, "edges")).crossJoin(one(labels, "labels"))  # one row each
