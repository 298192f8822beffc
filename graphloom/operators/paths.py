"""Paths of a rooted forest, and what is asked of them.

A query is a row ``qid, u, v``. Lowest common ancestors and aggregates that do not depend on the
direction come from binary lifting: a table for each power of two holds, for the vertices deep
enough, the ancestor so far up and the aggregate of the edges on the way; a query takes two such
steps a power, whatever the length of its path. Only where the path itself is asked for is it
one row an edge, in order from u to v.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, functions as F

from graphloom.operators.arrays import least, range_least
from graphloom.operators.components import connected_components
from graphloom.operators.graph import running_sums
from graphloom.operators.structure import MOST_EDGES, Structure
from graphloom.schema import NO_COVER
from graphloom.sources.scratch import discard, materialize

Merge = Callable[[Column, Column], Column]


def lifted(base: DataFrame, merge: dict[str, Merge]) -> list[DataFrame]:
    """``vertex_id, anc`` and values for each power of two. ``base`` has ``vertex_id, anc`` (the parent) and the values of the edge between."""
    tables = [materialize(base.select("vertex_id", "anc", *merge), "lift")]
    while True:
        t = tables[-1]
        far = t.select(F.col("vertex_id").alias("anc"), F.col("anc").alias("far"), *[F.col(c).alias(f"{c}_far") for c in merge])
        nxt = materialize(t.join(far, "anc").select("vertex_id", F.col("far").alias("anc"), *[m(F.col(c), F.col(f"{c}_far")).alias(c) for c, m in merge.items()]), "lift")
        if nxt.isEmpty():
            return tables
        tables.append(nxt)


def path_folds(forest: DataFrame, pairs: DataFrame, values: DataFrame | None = None, merge: dict[str, Merge] | None = None) -> DataFrame:
    """``qid, lca, path_len`` and a fold for each column of ``merge`` over the path's edges; only for connected pairs of known vertices.

    ``values`` has ``vertex_id`` and the value of the edge to its parent by column; a merge must be
    associative and commutative. A fold over no edges is null.
    """
    merge = merge or {}
    base = forest.where("parent is not null").select("vertex_id", F.col("parent").alias("anc"))
    if values is not None:
        base = base.join(values.select("vertex_id", *merge), "vertex_id")
    tables = lifted(base, merge)
    at = forest.select("vertex_id", "component_id", "depth")
    q = pairs.select("qid", "u", "v").join(at.toDF("u", "cu", "du"), "u").join(at.toDF("v", "cv", "dv"), "v").where("cu = cv")
    swap = F.col("du") < F.col("dv")
    q = q.select("qid", F.when(swap, F.col("v")).otherwise(F.col("u")).alias("x"), F.when(swap, F.col("u")).otherwise(F.col("v")).alias("y"), F.least("du", "dv").alias("d"), F.abs(F.col("du") - F.col("dv")).alias("up"),
                 (F.col("du") + F.col("dv")).alias("sum"), *[F.lit(None).cast(tables[0].schema[c].dataType).alias(c) for c in merge])
    q = materialize(q, "asked")

    def both(c, other):
        return F.when(F.col(c).isNull(), other).when(other.isNull(), F.col(c)).otherwise(merge[c](F.col(c), other))

    def stepped(q: DataFrame, table: DataFrame, ends: list[str], when: Column) -> DataFrame:
        """The ends taken up by a table where ``when`` holds and, for two ends, they then still differ. Rows that stay keep their key, so none is hot."""
        q = q.withColumn("_f", F.when(when, 1).otherwise(0))
        for e in ends:
            q = q.join(table.select(F.col("vertex_id").alias(e), F.col("anc").alias(f"_{e}"), F.lit(1).alias("_f"), *[F.col(c).alias(f"_{c}{e}") for c in merge]), [e, "_f"], "left")
        go = F.col(f"_{ends[0]}").isNotNull()
        if len(ends) == 2:
            go = go & (F.col("_x") != F.col("_y"))
        cols = [F.when(go, F.col(f"_{e}")).otherwise(F.col(e)).alias(e) if e in ends else F.col(e) for e in ("x", "y")]
        folds = []
        for c in merge:
            new = F.col(f"_{c}{ends[0]}") if len(ends) == 1 else merge[c](F.col(f"_{c}x"), F.col(f"_{c}y"))
            folds.append(F.when(go, both(c, new)).otherwise(F.col(c)).alias(c))
        return q.select("qid", *cols, "d", "up", "sum", *folds)

    def kept(q: DataFrame, n: int) -> DataFrame:
        return materialize(q, "asked") if n % 4 == 3 else q  # plans stay short

    for k, t in enumerate(tables):
        q = kept(stepped(q, t, ["x"], F.expr(f"shiftright(up, {k}) % 2 = 1")), k)
    for k in reversed(range(len(tables))):
        q = kept(stepped(q, tables[k], ["x", "y"], (F.col("x") != F.col("y"))), k)
    # one step more where the ends still differ: to their common parent
    last = tables[0].select(F.col("vertex_id").alias("x"), F.col("anc").alias("top"), F.lit(1).alias("_f"), *[F.col(c).alias(f"_{c}x") for c in merge])
    side = tables[0].select(F.col("vertex_id").alias("y"), F.lit(1).alias("_f"), *[F.col(c).alias(f"_{c}y") for c in merge])
    q = q.withColumn("_f", F.when(F.col("x") != F.col("y"), 1).otherwise(0)).join(last, ["x", "_f"], "left").join(side, ["y", "_f"], "left")
    folds = [F.when(F.col("top").isNull(), F.col(c)).otherwise(both(c, merge[c](F.col(f"_{c}x"), F.col(f"_{c}y")))).alias(c) for c in merge]
    q = materialize(q.select("qid", F.coalesce("top", "x").alias("lca"), "sum", *folds), "folds")
    discard(*tables)
    return q.join(at.select(F.col("vertex_id").alias("lca"), "depth"), "lca").select("qid", "lca", (F.col("sum") - 2 * F.col("depth")).alias("path_len"), *merge)


def edge_values(forest: DataFrame, edges: DataFrame, **columns: Column) -> DataFrame:
    """``vertex_id`` and columns of the edge to its parent."""
    return forest.where("parent is not null").select("vertex_id", F.col("parent_edge").alias("edge_id")).join(edges, "edge_id").select("vertex_id", *[c.alias(n) for n, c in columns.items()])


def subtree_sums(forest: DataFrame, marks: DataFrame, value: str) -> DataFrame:
    """``vertex_id, total``: the sum of ``value`` over the marks ``vertex_id, <value>`` at the vertices below each vertex, itself included. One running sum over the tour."""
    at = forest.select("vertex_id", "component_id", "tin", "tout")
    zero = F.lit(0).cast("long")
    rows = marks.join(at, "vertex_id").select("component_id", F.col("tin").alias("pos"), F.lit(1).alias("rank"), "vertex_id", F.col(value).cast("long").alias("x"))
    ends = at.select("component_id", "vertex_id", F.explode(F.array(F.struct(F.col("tin").alias("pos"), F.lit(0).alias("rank")), F.struct(F.col("tout").alias("pos"), F.lit(2).alias("rank")))).alias("e")).select("component_id", "e.pos", "e.rank", "vertex_id", zero.alias("x"))
    ran = running_sums(rows.unionByName(ends), ["component_id", "pos", "rank", "vertex_id"], {"x": "sum"}).where("rank <> 1")
    return ran.groupBy("vertex_id").agg(F.sum(F.when(F.col("rank") == 2, F.col("run_x")).otherwise(-F.col("run_x"))).alias("total"))


STEPS = "qid long, pos long, edge_id long, a long, b long"


#: Edges on all paths of a component that one task writes out, in five arrays.
MOST_STEPS = 8_000_000


def _walker(forest: pa.Table, asked: pa.Table) -> pa.Table:
    """All queries of a component take a step at a time."""
    ids, (parent, edge, depth) = _by_id(forest, "parent", "parent_edge", "depth")
    up = np.searchsorted(ids, parent)
    x, y = np.searchsorted(ids, asked["u"].to_numpy()), np.searchsorted(ids, asked["v"].to_numpy())
    i, j = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    found = [[np.empty(0, np.int64)] for _ in range(5)]
    on = np.flatnonzero(x != y)
    while len(on):
        from_u = depth[x[on]] >= depth[y[on]]
        q = on[from_u]
        for c, k in zip(found, (q, i[q], edge[x[q]], ids[x[q]], ids[up[x[q]]])):
            c.append(k)
        i[q] += 1
        x[q] = up[x[q]]
        q = on[~from_u]
        for c, k in zip(found, (q, -1 - j[q], edge[y[q]], ids[up[y[q]]], ids[y[q]])):  # from the end
            c.append(k)
        j[q] += 1
        y[q] = up[y[q]]
        on = on[x[on] != y[on]]
    q, pos, e, a, b = (np.concatenate(c) for c in found)
    return pa.table({"qid": asked["qid"].to_numpy()[q], "pos": np.where(pos < 0, pos + (i + j)[q], pos), "edge_id": e, "a": a, "b": b})


def _by_id(rows: pa.Table, *columns: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Vertices in order, and columns in that order; a root's parent is itself, other nulls are -1."""
    ids = rows["vertex_id"].to_numpy()
    order = np.argsort(ids)
    at = {c: pa.compute.coalesce(rows[c], rows["vertex_id"] if c == "parent" else pa.scalar(-1, pa.int64())).to_numpy()[order] for c in columns}
    return ids[order], [at[c] for c in columns]


def _climbed(forest: DataFrame, asked: DataFrame) -> DataFrame:
    """The same by rounds of joins, for components that no task should hold."""
    at = forest.select("vertex_id", "parent", "parent_edge", "depth")
    walk = asked.select("qid", F.col("u").alias("x"), F.col("v").alias("y"), F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"))
    found = []
    while True:
        walk = materialize(walk.where("x <> y"), "walk")
        if walk.isEmpty():
            break
        s = walk.join(at.toDF("x", "px", "ex", "dx"), "x").join(at.toDF("y", "py", "ey", "dy"), "y").withColumn("up", F.col("dx") >= F.col("dy"))
        s = materialize(s, "climb")
        found.append(s.select("qid", "up", F.when(F.col("up"), F.col("i")).otherwise(F.col("j")).alias("n"), F.when(F.col("up"), F.col("ex")).otherwise(F.col("ey")).alias("edge_id"), F.when(F.col("up"), F.col("x")).otherwise(F.col("py")).alias("a"), F.when(F.col("up"), F.col("px")).otherwise(F.col("y")).alias("b")))
        walk = s.select("qid", F.when(F.col("up"), F.col("px")).otherwise(F.col("x")).alias("x"), F.when(F.col("up"), F.col("y")).otherwise(F.col("py")).alias("y"), F.when(F.col("up"), F.col("i") + 1).otherwise(F.col("i")).alias("i"), F.when(F.col("up"), F.col("j")).otherwise(F.col("j") + 1).alias("j"))
    if not found:
        return asked.sparkSession.createDataFrame([], STEPS)
    rows = found[0]
    for x in found[1:]:
        rows = rows.unionByName(x)
    total = rows.groupBy("qid").agg(F.count("*").alias("len"))
    return rows.join(total, "qid").select("qid", F.when(F.col("up"), F.col("n")).otherwise(F.col("len") - 1 - F.col("n")).alias("pos"), "edge_id", "a", "b")


def path_edges(forest: DataFrame, pairs: DataFrame, most_vertices: int = MOST_EDGES) -> DataFrame:
    """``qid, pos, edge_id, a, b``: the edges from u to v in order, each crossed from a to b."""
    at = forest.select("vertex_id", "component_id", "depth")
    asked = pairs.join(at.toDF("u", "component_id", "du"), "u").join(at.toDF("v", "c2", "dv"), "v").where("component_id = c2 and u <> v")
    asked = materialize(asked.select("component_id", F.col("qid").cast("long").alias("qid"), "u", "v", (F.col("du") + F.col("dv")).alias("far")), "asked")
    steps = asked.groupBy("component_id").agg(F.sum("far").alias("n")).agg(F.max("n")).first()[0] or 0
    asked = asked.drop("far")
    held = forest.join(asked.select("component_id").distinct(), "component_id", "left_semi")
    most = held.groupBy("component_id").count().agg(F.max("count")).first()[0] or 0
    if most > most_vertices or steps > MOST_STEPS:
        return materialize(_climbed(forest, asked), "steps")
    held = held.select("component_id", "vertex_id", "parent", "parent_edge", "depth")
    return materialize(held.groupBy("component_id").cogroup(asked.groupBy("component_id")).applyInArrow(_walker, STEPS), "steps")


def path_vertices(steps: DataFrame, pairs: DataFrame, forest: DataFrame) -> DataFrame:
    """``qid, pos, vertex_id``: from u at 0 to v; for u = v the one vertex."""
    start = pairs.select("qid", F.col("u").alias("vertex_id"), "v").join(forest.select("vertex_id", "component_id"), "vertex_id")
    start = start.join(forest.select(F.col("vertex_id").alias("v"), F.col("component_id").alias("c2")), "v").where("component_id = c2")
    return start.select("qid", F.lit(0).cast("long").alias("pos"), "vertex_id").unionByName(steps.select("qid", (F.col("pos") + 1).alias("pos"), F.col("b").alias("vertex_id")))


def fold(steps: DataFrame, pairs: DataFrame, edges: DataFrame, **aggregates: Column) -> DataFrame:
    """``qid`` and the given aggregates over each path's edges with the columns of ``edges``; nulls without path."""
    got = steps.join(edges, "edge_id").groupBy("qid").agg(*[c.alias(n) for n, c in aggregates.items()])
    return pairs.select("qid").join(got, "qid", "left")


def ordered_edges(column: str = "edge_id") -> Column:
    """Aggregate: the path's edges in order; a fold that depends on the direction."""
    return F.transform(F.array_sort(F.collect_list(F.struct("pos", column))), lambda s: s[column])


def between(forest: DataFrame, pairs: DataFrame, cover: DataFrame) -> DataFrame:
    """``qid, cover_level, min_edge, bridge``: least cover on the path (``NO_COVER`` without path), the smallest edge of that cover, the smallest bridge."""
    values = edge_values(forest, cover.select("edge_id", "cover_level"), m=F.struct("cover_level", "edge_id"), bridge=F.when(F.col("cover_level") == -1, F.col("edge_id")))
    least = lambda a, b: F.least(a, b)
    got = path_folds(forest, pairs, values, {"m": least, "bridge": least})
    return pairs.select("qid").join(got, "qid", "left").select("qid", F.coalesce("m.cover_level", F.lit(NO_COVER)).cast("int").alias("cover_level"), F.col("m.edge_id").alias("min_edge"), "bridge")


def bridge_between(s: Structure, pairs: DataFrame) -> DataFrame:
    """``qid, cover_level, bridge`` as ``between`` gives them for the covers of a graph: -1 and the smallest bridge on the path, else 0, ``NO_COVER`` without path.

    Only pairs of different two-edge-connected components have a bridge between them, and look for it in the forest of bridges.
    """
    at = s.blocks.select("vertex_id", "component_id", "block")
    q = pairs.select("qid", "u", "v").join(at.toDF("u", "cu", "bu"), "u").join(at.toDF("v", "cv", "bv"), "v").where("cu = cv and u <> v")
    q = materialize(q.select("qid", "bu", "bv"), "asked")
    f = s.bridge_forest()
    far = q.where("bu <> bv").select("qid", F.col("bu").alias("u"), F.col("bv").alias("v"))
    values = edge_values(f.rooted, f.graph.edges.select("edge_id"), bridge=F.col("edge_id"))
    got = path_folds(f.rooted, far, values, {"bridge": lambda a, b: F.least(a, b)}).select("qid", F.lit(-1).alias("level"), "bridge")
    got = got.unionByName(q.where("bu = bv").select("qid", F.lit(0).alias("level"), F.lit(None).cast("long").alias("bridge")))
    return pairs.select("qid").join(got, "qid", "left").select("qid", F.coalesce("level", F.lit(NO_COVER)).cast("int").alias("cover_level"), "bridge")


def len_sum_max(forest: DataFrame, pairs: DataFrame, edges: DataFrame, weight: str = "weight") -> DataFrame:
    """``qid, path_len, path_sum, path_max``: 0 for equal ends, null without path."""
    w = F.col(weight)
    got = path_folds(forest, pairs, edge_values(forest, edges.select("edge_id", weight), path_sum=w, path_max=w), {"path_sum": lambda a, b: a + b, "path_max": lambda a, b: F.greatest(a, b)})
    zero = lambda c: F.when(F.col("path_len").isNotNull(), F.coalesce(c, F.lit(0))).alias(c)
    return pairs.select("qid").join(got, "qid", "left").select("qid", "path_len", zero("path_sum"), zero("path_max"))


def level_components(vertices: DataFrame, cover: DataFrame, levels: DataFrame) -> DataFrame:
    """``level, vertex_id, part``: components of the forest edges of that cover level or more, for every level asked; all levels in one pass."""
    at = levels.select("level").distinct()
    e = cover.where("cover_level is not null").select("u", "v", "cover_level").join(F.broadcast(at), F.col("cover_level") >= F.col("level")).select("level", "u", "v")  # levels: 34 at most
    parts = connected_components(e, by=["level"]).withColumnRenamed("component_id", "part")
    own = vertices.select("vertex_id").crossJoin(F.broadcast(at))
    return materialize(own.join(parts, ["level", "vertex_id"], "left").select("level", "vertex_id", F.coalesce("part", "vertex_id").alias("part")), "parts")


def find_size(queries: DataFrame, forest: DataFrame, cover: DataFrame) -> DataFrame:
    """``qid, size`` for queries ``qid, u, v, level``: vertices whose cover level to the path is ``level`` or more; 0 if unconnected.

    These are the parts of that level that the path meets: the one of the lowest common ancestor,
    and below each edge of a smaller level on the path the part under it. The sizes are summed
    by lifting, for all levels asked at once.
    """
    parts = level_components(forest, cover, queries)
    sized = materialize(parts.join(parts.groupBy("level", "part").agg(F.count("*").alias("size")), ["level", "part"]).select("level", "vertex_id", "size"), "sized")
    under = edge_values(forest, cover.select("edge_id", "cover_level"), cover_level=F.col("cover_level"))
    cut = sized.join(under, "vertex_id").groupBy("vertex_id").agg(F.map_from_entries(F.collect_list(F.struct("level", F.when(F.col("cover_level") < F.col("level"), F.col("size")).otherwise(F.lit(0)).alias("n")))).alias("cut"))
    add = lambda a, b: F.map_zip_with(a, b, lambda _, x, y: x + y)
    got = path_folds(forest, queries, cut, {"cut": add})
    met = queries.select("qid", "level").join(got, "qid").join(sized.withColumnRenamed("vertex_id", "lca"), ["lca", "level"])
    met = met.select("qid", (F.col("size") + F.coalesce(F.col("cut")[F.col("level")], F.lit(0))).alias("size"))
    return queries.select("qid").join(met, "qid", "left").select("qid", F.coalesce("size", F.lit(0)).alias("size"))


def _hanging(rows: pa.Table, asked: pa.Table) -> pa.Table:
    """First labels of a component. What hangs on a path's vertex, inside its part and off the path, are ranges of the part's vertices in the order of the walk."""
    of_vertex = rows["label_id"].is_null()
    ids, (parent, tin, tout, depth, covered) = _by_id(rows.filter(of_vertex), "parent", "tin", "tout", "depth", "level")
    n, up = len(ids), np.searchsorted(ids, parent)
    first_tin = tin.min()  # a large tree's root is at -1
    tin, tout = tin - first_tin, tout - first_tin
    width = int(tout.max()) + 1
    labels = rows.filter(pa.compute.invert(of_vertex))
    label_at, label_level, label_id = np.searchsorted(ids, labels["vertex_id"].to_numpy()), labels["level"].to_numpy(), labels["label_id"].to_numpy()
    qid, level = asked["qid"].to_numpy(), asked["level"].to_numpy()
    u, v = np.searchsorted(ids, asked["u"].to_numpy()), np.searchsorted(ids, asked["v"].to_numpy())
    out_q, out_label = [], []
    for l in np.unique(level):
        tied = (up != np.arange(n)) & (covered >= l)
        part = least(n, np.flatnonzero(tied), up[tied])
        key = part * width + tin
        order = np.argsort(key)
        key = key[order]
        lo = np.searchsorted(key, part * width + tin)
        hi = np.searchsorted(key, part * width + tout, "right")
        here = label_level == l
        label = np.zeros(n, np.int64)
        label[label_at[here]] = label_id[here]
        has = np.zeros(n, bool)
        has[label_at[here]] = True
        value = np.where(has[order], order, n)
        before = np.concatenate([[0], np.cumsum(has[order])])
        q = np.flatnonzero(level == l)
        x, y, cx, cy = u[q], v[q], np.full(len(q), -1), np.full(len(q), -1)
        cuts = np.zeros((4, len(q)), np.int64)  # the range of the place found, and the two below it that are on the path
        holes = np.zeros((2, len(q)), np.int64)

        def below(c):
            """The range of a child on the path, if it is in its parent's part."""
            out = (c >= 0) & tied[c]
            return np.where(out, lo[c], 0), np.where(out, hi[c], 0)

        def kept(k, start, end, one, two=None):
            """Puts down the places ``start`` to ``end`` without those below for the queries ``k`` that have a label there; says which."""
            a0, a1 = below(one)
            b0, b1 = below(two) if two is not None else (np.zeros(len(k), np.int64),) * 2
            there = before[end] - before[start] - (before[a1] - before[a0]) - (before[b1] - before[b0]) > 0
            swap = b0 < a0  # empty ones are at 0, so first
            a0, a1, b0, b1 = np.where(swap, b0, a0), np.where(swap, b1, a1), np.where(swap, a0, b0), np.where(swap, a1, b1)
            a0, a1 = np.where(a1 > a0, a0, start), np.where(a1 > a0, a1, start)
            b0, b1 = np.where(b1 > b0, b0, a1), np.where(b1 > b0, b1, a1)
            w = k[there]
            cuts[:, w] = start[there], a0[there], a1[there], b0[there]
            holes[:, w] = b1[there], end[there]
            return there

        on = np.arange(len(q))
        while len(on):
            met = x[on] == y[on]
            k = on[met]
            first, last = np.searchsorted(key, part[x[k]] * width), np.searchsorted(key, (part[x[k]] + 1) * width)
            kept(k, first, last, cx[k], cy[k])
            on = on[~met]
            from_u = depth[x[on]] >= depth[y[on]]
            k = on[from_u]
            done = kept(k, lo[x[k]], hi[x[k]], cx[k])
            cx[k] = x[k]
            x[k] = up[x[k]]
            w = on[~from_u]  # the last of these on the way up is the first on the path
            kept(w, lo[y[w]], hi[y[w]], cy[w])
            cy[w] = y[w]
            y[w] = up[y[w]]
            on = np.concatenate([k[~done], w])
        best = np.minimum(range_least(value, cuts[0], cuts[1], n), np.minimum(range_least(value, cuts[2], cuts[3], n), range_least(value, holes[0], holes[1], n)))
        got = best < n
        out_q.append(qid[q[got]])
        out_label.append(label[best[got]])
    return pa.table({"qid": np.concatenate(out_q), "label_id": np.concatenate(out_label)})


def find_first_label(queries: DataFrame, forest: DataFrame, cover: DataFrame, labels: DataFrame, most_vertices: int = MOST_EDGES) -> DataFrame:
    """``qid, label_id`` for queries ``qid, u, v, level``: of the labels of exactly this level at vertices of that cover level to the path, the one whose meeting place with the path is nearest to u, then the smallest vertex and label; null if none.

    A task walks the paths of a component and looks up what hangs on their vertices, so no query meets a label that is not its
    answer; queries in components of more than ``most_vertices``, or of very long paths, are compared with the labels of the first part that has any.
    """
    at = forest.select("vertex_id", "component_id", "depth")
    asked = queries.select("qid", "u", "v", "level").join(at.toDF("u", "component_id", "du"), "u").join(at.toDF("v", "c2", "dv"), "v").where("component_id = c2")
    asked = materialize(asked.select("component_id", F.col("qid").cast("long").alias("qid"), "u", "v", F.col("level").cast("long").alias("level"), (F.col("du") + F.col("dv")).alias("far")), "asked")
    size = forest.groupBy("component_id").agg(F.count("*").alias("n"))
    far = asked.groupBy("component_id").agg(F.sum("far").alias("far"))
    fits = materialize(size.join(far, "component_id").withColumn("fits", (F.col("n") <= most_vertices) & (F.col("far") <= 4 * MOST_STEPS)).select("component_id", "fits"), "fits")
    some = fits.where("fits").select("component_id")
    none = F.lit(None).cast("long")
    rows = forest.select("component_id", "vertex_id", "parent", "tin", "tout", "depth", F.col("parent_edge").alias("edge_id")).join(cover.select("edge_id", F.coalesce("cover_level", F.lit(NONE)).cast("long").alias("level")), "edge_id", "left").select("component_id", "vertex_id", "parent", "tin", "tout", "depth", "level", none.alias("label_id"))
    one = labels.groupBy("vertex_id", "level").agg(F.min("label_id").cast("long").alias("label_id")).join(at.select("vertex_id", "component_id"), "vertex_id")
    rows = rows.unionByName(one.select("component_id", "vertex_id", F.col("level").cast("long").alias("level"), "label_id"), allowMissingColumns=True).join(some, "component_id", "left_semi")
    mine = asked.drop("far").join(some, "component_id", "left_semi")
    best = rows.groupBy("component_id").cogroup(mine.groupBy("component_id")).applyInArrow(_hanging, "qid long, label_id long")
    if not fits.where("not fits").isEmpty():
        others = fits.where("not fits").select("component_id")
        rest = queries.join(asked.join(others, "component_id", "left_semi").select("qid"), "qid", "left_semi")
        inside = forest.join(others, "component_id", "left_semi")
        best = best.unionByName(_first_label_by_pairs(rest, inside, cover.join(inside.select(F.col("parent_edge").alias("edge_id")), "edge_id", "left_semi"), labels).where("label_id is not null"))
    return queries.select("qid").join(best, "qid", "left").select("qid", "label_id")


#: Stands for the cover of no edge, under every level.
NONE = -(2**31)


def _first_label_by_pairs(queries: DataFrame, forest: DataFrame, cover: DataFrame, labels: DataFrame) -> DataFrame:
    """The same by joins.

    The parts that the path meets are told apart by the edges of smaller level on it; a query is
    compared with the labels of the parts that its path meets, and meeting places are the
    deepest of three lowest common ancestors.
    """
    parts = level_components(forest, cover, queries)
    has = materialize(labels.select("vertex_id", "level", "label_id").join(parts, ["level", "vertex_id"]), "labelled")
    steps = path_edges(forest, queries.select("qid", "u", "v"))
    on = path_vertices(steps, queries, forest).join(queries.select("qid", "level"), "qid").join(parts, ["level", "vertex_id"])
    first = on.groupBy("qid", "level", "part").agg(F.min("pos").alias("pos")).join(has.select("level", "part").distinct(), ["level", "part"])
    # parts follow each other along the path: the first that has a label holds the answer
    first = first.groupBy("qid", "level").agg(F.min_by("part", "pos").alias("part"))
    cand = materialize(first.join(has, ["level", "part"]).select("qid", F.col("vertex_id").alias("w"), "label_id"), "near")
    ends = cand.select("qid", "w").distinct().join(queries.select("qid", "u", "v"), "qid")
    # lowest common ancestors of w with both ends; pairs asked twice are asked once
    pairs = ends.select("w", F.explode(F.array("u", "v")).alias("e")).distinct()
    pairs = materialize(pairs.withColumn("k", F.monotonically_increasing_id()), "meet")
    lca = path_folds(forest, pairs.select(F.col("k").alias("qid"), F.col("w").alias("u"), F.col("e").alias("v"))).select(F.col("qid").alias("k"), "lca")
    lca = pairs.join(lca, "k").join(forest.select(F.col("vertex_id").alias("lca"), "depth"), "lca").select("w", "e", "depth")
    top = path_folds(forest, queries.select("qid", "u", "v")).join(queries.select("qid", "u"), "qid").join(forest.select(F.col("vertex_id").alias("u"), F.col("depth").alias("du")), "u").join(forest.select(F.col("vertex_id").alias("lca"), F.col("depth").alias("dl")), "lca").select("qid", "du", "dl")
    met = ends.join(lca.toDF("w", "u", "a"), ["w", "u"]).join(lca.toDF("w", "v", "b"), ["w", "v"]).join(top, "qid")
    # the meeting place is above u where u's ancestor is the deeper one, else above v
    met = met.select("qid", "w", F.when(F.col("a") >= F.col("b"), F.col("du") - F.greatest("a", "dl")).otherwise(F.col("du") + F.col("b") - 2 * F.col("dl")).alias("dist"))
    best = cand.join(met, ["qid", "w"]).groupBy("qid").agg(F.min(F.struct("dist", "w", "label_id")).alias("m"))
    return queries.select("qid").join(best, "qid", "left").select("qid", F.col("m.label_id").alias("label_id"))


def incident_mask(queries: DataFrame, forest: DataFrame, cover: DataFrame, labels: DataFrame) -> DataFrame:
    """``qid, mask``: bit ``level + 1`` is set where such a label exists, over all levels of the labels.

    A vertex's bits tell which levels have a label in its part of that level; a path's are those of
    its vertices, found by lifting. For u = v this is the point form.
    """
    parts = level_components(forest, cover, labels)
    has = labels.select("vertex_id", "level").distinct().join(parts, ["level", "vertex_id"]).select("level", "part").distinct()
    bits = parts.join(has, ["level", "part"]).groupBy("vertex_id").agg(F.bit_or(F.expr("shiftleft(1L, level + 1)")).alias("mask"))
    own = materialize(forest.select("vertex_id", "parent").join(bits, "vertex_id", "left").select("vertex_id", "parent", F.coalesce("mask", F.lit(0).cast("long")).alias("mask")), "masks")
    got = path_folds(forest, queries, own.where("parent is not null").select("vertex_id", "mask"), {"mask": lambda a, b: a.bitwiseOR(b)})
    top = got.join(own.select(F.col("vertex_id").alias("lca"), F.col("mask").alias("at")), "lca").select("qid", F.coalesce("mask", F.lit(0).cast("long")).bitwiseOR(F.col("at")).alias("mask"))
    return queries.select("qid").join(top, "qid", "left").select("qid", F.coalesce("mask", F.lit(0)).alias("mask"))
