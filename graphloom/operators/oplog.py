"""Graphs as an ordered log of operations, asked as of any place in it.

Log rows: ``seq, op, edge_id, u, v`` with op one of add_vertex (u), remove_vertex (u), link,
remove_edge (edge_id). A state is a filter on intervals. Questions at many places are answered
together by dividing the places: an edge that lives through all places of a block is contracted
once for the block, the others go on to the parts of the block that they live in. A block then
holds only what changes inside it, so the work grows with the log and the questions, not with
their product.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from graphloom.operators.components import connected_components
from graphloom.operators.graph import Graph, with_sequence
from graphloom.sources.scratch import discard, materialize

#: Later than every place of a log.
FOREVER = 2**63 - 1
#: Parts of a block of places.
PARTS = 16


def vertex_lives(log: DataFrame) -> DataFrame:
    """``vertex_id, born, dies``: from the first row that adds or links it; gone for good with its first removal after that. A removal before is stale and does nothing."""
    born = log.where("op = 'add_vertex'").select(F.col("u").alias("vertex_id"), "seq").unionByName(log.where("op = 'link'").select(F.explode(F.array("u", "v")).alias("vertex_id"), "seq")).groupBy("vertex_id").agg(F.min("seq").alias("born"))
    gone = log.where("op = 'remove_vertex'").select(F.col("u").alias("vertex_id"), "seq").join(born, "vertex_id").where("seq > born").groupBy("vertex_id").agg(F.min("seq").alias("dies"))
    return born.join(gone, "vertex_id", "left").select("vertex_id", "born", F.coalesce("dies", F.lit(FOREVER)).alias("dies"))


def edge_lives(log: DataFrame) -> DataFrame:
    """``edge_id, u, v, born, dies``: from its link up to its first removal after that or the removal of an end.

    A self-loop, a link to a vertex already removed and a link by an id linked before are refused.
    A removal logged before the link is stale and does nothing.
    """
    first = log.where("op = 'link'").groupBy("edge_id").agg(F.min(F.struct("seq", "u", "v")).alias("l"))
    new = first.select("edge_id", "l.u", "l.v", F.col("l.seq").alias("born")).where("u <> v")
    cut = log.where("op = 'remove_edge'").select("edge_id", "seq").join(new.select("edge_id", "born"), "edge_id").where("seq > born").groupBy("edge_id").agg(F.min("seq").alias("cut"))
    gone = vertex_lives(log).where(F.col("dies") < FOREVER).select(F.col("vertex_id").alias("x"), F.col("dies").alias("gone"))
    ends = new.select("edge_id", F.explode(F.array("u", "v")).alias("x")).join(gone, "x").groupBy("edge_id").agg(F.min("gone").alias("gone"))
    return new.join(cut, "edge_id", "left").join(ends, "edge_id", "left").where("gone is null or gone > born").select("edge_id", "u", "v", "born", F.coalesce(F.least("cut", "gone"), F.lit(FOREVER)).alias("dies"))


def snapshot(log: DataFrame, seq: int) -> Graph:
    """The graph after the operation ``seq``."""
    e = edge_lives(log).where((F.col("born") <= seq) & (F.col("dies") > seq))
    v = vertex_lives(log).where((F.col("born") <= seq) & (F.col("dies") > seq)).select("vertex_id")
    return Graph.of_edges(e.select("edge_id", "u", "v", F.col("born").alias("seq")), v)


def _places(times: DataFrame, n: int) -> DataFrame:
    """``t, k``: the distinct places, numbered from 0 in order."""
    return with_sequence(times.select("t").distinct(), "t", name="k").select("t", (F.col("k") - 1).alias("k"))


def _span(lives: DataFrame, places: DataFrame) -> DataFrame:
    """``i, j`` for each life: the first and last number of a place at which it lives; lives without any are left out.

    A running maximum over places and ends in one order: no life meets all places.
    """
    cuts = places.select(F.col("t").alias("x"), F.lit(1).alias("kind"), F.col("k").alias("k"), F.lit(None).cast("long").alias("edge_id"), F.lit(None).cast("string").alias("end"))
    none = F.lit(None).cast("long")
    # places before the birth: t < born; places up to the death: t < dies
    ends = lives.select(F.explode(F.array(F.struct(F.col("born").alias("x"), F.lit("born").alias("end")), F.struct(F.col("dies").alias("x"), F.lit("dies").alias("end")))).alias("e"), "edge_id").select("e.x", F.lit(0).alias("kind"), none.alias("k"), "edge_id", "e.end")
    ran = running(cuts.unionByName(ends), ["x", "kind", "edge_id", "end"], "k")
    at = ran.where("kind = 0").groupBy("edge_id").agg(F.max(F.when(F.col("end") == "born", F.coalesce("run", F.lit(-1)))).alias("b"), F.max(F.when(F.col("end") == "dies", F.coalesce("run", F.lit(-1)))).alias("d"))
    return lives.join(at, "edge_id").select("u", "v", (F.col("b") + 1).alias("i"), F.col("d").alias("j")).where("i <= j")


def running(rows: DataFrame, order: list[str], value: str) -> DataFrame:
    """``rows`` with ``run``: the largest ``value`` of this and all rows before, in the given order. A range sort; no task sees all rows."""
    from pyspark.sql import Window

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(rows.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()), "ranges")
    most = dealt.groupBy("_p").agg(F.max(value).alias("_m"))
    before = most.select("_p", F.max("_m").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)).alias("_b"))  # a row a partition
    own = F.max(value).over(Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("run", own).join(F.broadcast(before), "_p").withColumn("run", F.greatest("run", "_b")).drop("_p", "_b")


def components_at(log: DataFrame, points: DataFrame, parts: int = PARTS) -> DataFrame:
    """``t, vertex_id, component_id`` for distinct points ``t, vertex_id``: the smallest vertex of its component after operation t.

    A vertex that does not live then has a null component.
    """
    points = materialize(points.select("t", "vertex_id").distinct(), "points")
    places = materialize(_places(points, parts), "places")
    m = places.count()
    size = 1
    while size < m:
        size *= parts
    lives = vertex_lives(log)
    alive = points.join(lives, "vertex_id").where("born <= t and dies > t").join(places, "t")
    # x: the vertex that stands for the point in its block so far
    now = materialize(alive.select("t", "vertex_id", "k", F.col("vertex_id").alias("x")), "points")
    edges = materialize(_span(edge_lives(log), places), "spans")
    while True:
        block = F.floor(F.col("k") / size).cast("long")
        # an edge goes to all blocks that it lives in: through some, in part of two at most
        met = edges.select("u", "v", "i", "j", F.explode(F.sequence(F.floor(F.col("i") / size), F.floor(F.col("j") / size))).alias("b"))
        met = met.withColumn("lo", F.greatest("i", F.col("b") * size)).withColumn("hi", F.least("j", F.col("b") * size + size - 1))
        whole = (F.col("hi") - F.col("lo") + 1) == F.least(F.lit(size), F.lit(m) - F.col("b") * size)
        met = materialize(met.select("b", "u", "v", F.col("lo").alias("i"), F.col("hi").alias("j"), whole.alias("whole")), "blocks")
        comp = materialize(connected_components(met.where("whole"), by=["b"]).toDF("b", "x", "c"), "contracted")
        at = now.withColumn("b", block).join(comp, ["b", "x"], "left").select("t", "vertex_id", "k", F.coalesce("c", "x").alias("x"))
        discarded, now = now, materialize(at, "points")
        discard(discarded)
        if size == 1:
            break
        left = met.where("not whole")
        for end in ("u", "v"):
            left = left.join(comp.toDF("b", end, "c"), ["b", end], "left").withColumn(end, F.coalesce("c", end)).drop("c")
        before, edges = edges, materialize(left.where("u <> v").select("u", "v", "i", "j").distinct(), "spans")
        discard(before, met, comp)
        size //= parts
    return points.join(now.select("t", "vertex_id", F.col("x").alias("component_id")), ["t", "vertex_id"], "left")


def as_of_connected(log: DataFrame, queries: DataFrame) -> DataFrame:
    """``qid, connected`` for ``qid, t, u, v``: whether both live and are connected after operation t."""
    ends = queries.select("t", F.explode(F.array("u", "v")).alias("vertex_id"))
    at = materialize(components_at(log, ends), "as_of")
    j = queries.join(at.toDF("t", "u", "ca"), ["t", "u"], "left").join(at.toDF("t", "v", "cb"), ["t", "v"], "left")
    return j.select("qid", F.coalesce(F.col("ca") == F.col("cb"), F.lit(False)).alias("connected"))


def removed_bridges(log: DataFrame) -> DataFrame:
    """``seq, edge_id, was_bridge`` of each removal of a living edge: whether its ends are apart right after it."""
    gone = log.where("op = 'remove_edge'").select("seq", "edge_id").join(edge_lives(log), "edge_id").where("dies = seq")
    gone = materialize(gone.select(F.col("seq").alias("qid"), F.col("seq").alias("t"), "edge_id", "u", "v"), "removed")
    return gone.join(as_of_connected(log, gone), "qid").select(F.col("qid").alias("seq"), "edge_id", (~F.col("connected")).alias("was_bridge"))


def removed_vertices(log: DataFrame) -> DataFrame:
    """``seq, vertex_id, parts``: for each removal of a living vertex the smallest former neighbour in every component it leaves, sorted."""
    gone = log.where("op = 'remove_vertex'").select("seq", F.col("u").alias("x")).join(vertex_lives(log).toDF("x", "born", "dies"), "x").where("dies = seq").select("seq", "x")
    e = edge_lives(log).select("u", "v", F.col("dies").alias("seq"))
    sides = e.select("seq", F.col("u").alias("x"), F.col("v").alias("y")).unionByName(e.select("seq", F.col("v").alias("x"), F.col("u").alias("y")))
    near = materialize(gone.join(sides, ["seq", "x"]).select(F.col("seq").alias("t"), F.col("y").alias("vertex_id")).distinct(), "near")
    part = components_at(log, near).groupBy("t", "component_id").agg(F.min("vertex_id").alias("y"))
    got = part.groupBy(F.col("t").alias("seq")).agg(F.sort_array(F.collect_list("y")).alias("parts"))
    return gone.join(got, "seq", "left").select("seq", F.col("x").alias("vertex_id"), F.coalesce("parts", F.array().cast("array<long>")).alias("parts"))


def refresh(old: DataFrame, edges: DataFrame, touched: DataFrame) -> DataFrame:
    """``vertex_id, component_id`` after changes: only components that hold a touched vertex are found anew.

    ``old`` are the components before, ``edges`` the living edges after, ``touched`` the ends of
    all added and removed edges and all new vertices.
    """
    hit = old.join(touched.select("vertex_id").distinct(), "vertex_id", "left_semi").select("component_id").distinct()
    stale = old.join(hit, "component_id", "left_semi").select("vertex_id").unionByName(touched.select("vertex_id")).distinct()
    stale = materialize(stale, "stale")
    inside = edges.join(stale.withColumnRenamed("vertex_id", "u"), "u", "left_semi")
    new = stale.join(connected_components(inside), "vertex_id", "left").select("vertex_id", F.coalesce("component_id", "vertex_id").alias("component_id"))
    return old.select("vertex_id", "component_id").join(stale, "vertex_id", "left_anti").unionByName(new)
