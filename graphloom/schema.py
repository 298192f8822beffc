"""Tables of the engine and their checks. Ids are never reused, so a stale id matches nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

VERTICES = "vertex_id long"
EDGES = "edge_id long, u long, v long, weight long, seq long"
LABELS = "label_id long, vertex_id long, level int, weight long"
OP_LOG = "seq long, op string, edge_id long, u long, v long, level int, weight long"
KV = "key long, value long"

#: Levels run from -1 (bridge) to 32. A path without edges has the largest int instead, above every level.
MIN_LEVEL, MAX_LEVEL = -1, 32
NO_COVER = 2147483647


def valid_level(level: Column) -> Column:
    """The level where it is in range, else null: levels are rejected, never clamped."""
    return F.when(level.between(MIN_LEVEL, MAX_LEVEL), level)


def next_level(level: Column) -> Column:
    """The level after; the highest has none."""
    return F.when(level.between(MIN_LEVEL, MAX_LEVEL - 1), level + 1)


def split_self_loops(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges between different vertices, and the self-loops, which the graph rejects."""
    return edges.where("u <> v"), edges.where("u = v")
