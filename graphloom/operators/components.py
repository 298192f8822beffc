"""Connected components of an undirected multigraph.

First every task names the vertices of its own edges, in arrays, by the least that they reach there.
A vertex that several tasks name links the names, and the names' components remain to be found: where edges
near each other in the table belong together, these are few. They come from
alternating large-star and small-star rounds (Kiveris et al., 2014): each round is two
hash aggregations and two joins, every vertex sends a row per neighbour and never a list
of them, and the number of rounds grows with the logarithm of the diameter. A vertex of
very many neighbours is a large key of the joins: they are plain equi-joins, which adaptive
execution splits, and what meets there is one row of the vertex. Once ``FEW`` edges are left, or
were there from the start, one task finishes them in arrays.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from graphloom.operators.arrays import batches_of, chunks, dense, least
from graphloom.sources.scratch import discard, materialize

#: Edges that one task finishes: 16 MB, and about ten arrays of that length on the way.
FEW = 1_000_000
#: Edges that a task takes at a time.
CHUNK = 2_000_000


def _named(table: pa.Table, with_roots: bool):
    """Vertices, by the keys before the last two columns, with the least vertex of their component."""
    names = table.schema.names
    by = [table[c].combine_chunks().dictionary_encode() for c in names[:-2]]
    if not by:
        ids, u, v = dense(table["a"].to_numpy(), table["b"].to_numpy())
        label = least(len(ids), u, v)
        keys = []
    else:
        key = [np.tile(c.indices.to_numpy(zero_copy_only=False).astype(np.int64), 2) for c in by]
        ends = np.concatenate([table["a"].to_numpy(), table["b"].to_numpy()])
        order = np.lexsort((ends, *key[::-1]))
        new = np.zeros(len(ends), bool)
        new[0] = True
        for k in (*key, ends):
            new[1:] |= k[order][1:] != k[order][:-1]
        node = np.empty(len(ends), np.int64)
        node[order] = np.cumsum(new) - 1
        first = order[new]  # an entry of each node, by key and vertex
        ids, keys = ends[first], [k[first] for k in key]
        label = least(len(first), *np.split(node, 2))
    rest = np.arange(len(label)) if with_roots else np.flatnonzero(label != np.arange(len(label)))
    cols = {n: c.dictionary.take(pa.array(k[rest])) for n, c, k in zip(names, by, keys)}
    yield from batches_of({**cols, "a": ids[rest], "b": ids[label[rest]]})


def _each(batches, most: int):
    """Every endpoint in a task's edges, ``most`` at a time, with the least vertex that it reaches there."""
    for table in chunks(batches, most):
        yield from _named(table, True)


def _finished(batches):
    """The same stars as rounds end in: every vertex that is not the least of its component with the least."""
    batches = [b for b in batches if b.num_rows]
    if batches:
        yield from _named(pa.Table.from_batches(batches).combine_chunks(), False)


def _stars(edges: DataFrame, by: list[str]) -> DataFrame:
    """One round; edges (a, b) with a > b."""
    both = edges.select(*by, "a", "b").unionByName(edges.select(*by, F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy(*by, "a").agg(F.min("b").alias("m")).select(*by, "a", F.least("a", "m").alias("m"))
    large = both.where("b > a").join(low, [*by, "a"]).where("b <> m").select(*by, F.col("b").alias("a"), F.col("m").alias("b"))
    # a vertex that is larger than all its neighbours keeps its edge to the least of them
    large = large.unionByName(low.where("a <> m").select(*by, "a", F.col("m").alias("b"))).distinct()
    least = large.groupBy(*by, "a").agg(F.min("b").alias("m"))
    small = large.join(least, [*by, "a"]).where("b <> m").select(*by, F.col("b").alias("a"), F.col("m").alias("b"))
    return small.unionByName(least.select(*by, "a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", by: list[str] | None = None, most_rounds: int = 200) -> DataFrame:
    """``vertex_id, component_id`` for every endpoint; the id is the smallest vertex reachable.

    ``by`` names columns that tell graphs apart: all graphs of the table are found together, and
    the result has these columns first. Self-loops name their vertex and link nothing. Rows with
    a null endpoint are ignored. An empty table gives an empty table.
    """
    names, by = by or [], [f"_k{i}" for i in range(len(by or []))]
    ends = edges.select(*[F.col(n).alias(k) for n, k in zip(names, by)], F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).where("u is not null and v is not null")
    keyed = ends.select(*by, F.col("u").alias("a"), F.col("v").alias("b"))
    first = materialize(keyed.mapInArrow(partial(_each, most=CHUNK), T.StructType(keyed.schema.fields)), "named")
    last = Window.partitionBy(*by, "a").orderBy("b")
    ran = first.withColumn("p", F.lag("b").over(last)).where("p is null or p <> b")
    ran = materialize(ran, "names")
    discard(first)
    now = materialize(ran.where("p is not null").select(*by, F.col("b").alias("a"), F.col("p").alias("b")).distinct(), "stars")
    mark = None
    for _ in range(most_rounds):
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*by, "a", "b").cast("decimal(20,0)")).alias("s")).first()
        if seen["n"] == 0 or seen == mark:
            break
        if seen["n"] <= FEW:
            before, now = now, materialize(now.coalesce(1).mapInArrow(_finished, T.StructType(now.schema.fields)), "stars")
            discard(before)
            break
        mark = seen
        before, now = now, materialize(_stars(now, by), "stars")
        discard(before)
    else:
        raise RuntimeError(f"components did not converge in {most_rounds} rounds")
    label = ran.where("p is null").select(*by, F.col("a").alias("vertex_id"), F.col("b"))
    if mark is None and seen["n"] == 0:  # no vertex has two names
        return label.select(*[F.col(k).alias(n) for n, k in zip(names, by)], "vertex_id", F.col("b").alias("component_id"))
    roots = now.select(*by, F.col("a").alias("b"), F.col("b").alias("component_id"))
    return label.join(roots, [*by, "b"], "left").select(*[F.col(k).alias(n) for n, k in zip(names, by)], "vertex_id", F.coalesce("component_id", "b").alias("component_id"))
