"""One query for each operator, over graphs made of the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from graphloom.functions.aggregates import NAMED, PathAggregate, component_fold
from graphloom.operators import cover as C, labels as B, oplog as L, ordered_map as M, paths as P
from graphloom.operators.graph import Graph
from graphloom.operators.structure import forest_link
from graphloom.schema import MAX_LEVEL, next_level, split_self_loops, valid_level
from graphloom.sources.graphs import graph, structure

BASE = 10**12


def part_pairs(spark, sf) -> DataFrame:
    """Every part with another one: ``qid, u, v`` in the ids of the part-supplier graph."""
    p = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("qid"))
    n = spark.read.parquet(f"{sf}/part.parquet").agg(F.max("p_partkey").alias("n"))
    return p.crossJoin(F.broadcast(n)).select("qid", (2 * F.col("qid")).alias("u"), (2 * ((F.col("qid") * 37) % F.col("n") + 1)).alias("v"))


def order_pairs(spark, sf) -> DataFrame:
    """Every order with another one, in the ids of the order-part graph."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    n = o.agg(F.max("o_orderkey").alias("n"))  # one row
    return o.select(F.col("o_orderkey").alias("qid")).crossJoin(F.broadcast(n)).select("qid", (2 * F.col("qid")).alias("u"), (2 * ((F.col("qid") * 37) % F.col("n") + 1)).alias("v"))


def customer_pairs(spark, sf) -> DataFrame:
    """Every customer with another one, in the ids of the hierarchy."""
    c = spark.read.parquet(f"{sf}/customer.parquet")
    n = c.agg(F.max("c_custkey").alias("n"))
    return c.select(F.col("c_custkey").alias("qid")).crossJoin(F.broadcast(n)).select("qid", (F.col("qid") + 3 * BASE).alias("u"), ((F.col("qid") * 37) % F.col("n") + 1 + 3 * BASE).alias("v"))


def customer_updates(spark, sf) -> DataFrame:
    """An update of the hierarchy's paths by every customer: ``seq, u, v, op, level, x``."""
    return customer_pairs(spark, sf).select(F.col("qid").alias("seq"), "qid", "u", "v", F.when(F.col("qid") % 3 == 0, "uncover").otherwise("cover").alias("op"), (F.col("qid") % 5).cast("int").alias("level"), (F.col("qid") % 11).alias("x"))


def customer_labels(spark, sf) -> DataFrame:
    c = spark.read.parquet(f"{sf}/customer.parquet").where("c_acctbal > 0")
    return c.select(F.col("c_custkey").alias("label_id"), (F.col("c_custkey") + 3 * BASE).alias("vertex_id"), (F.col("c_custkey") % 3).cast("int").alias("level"), (F.col("c_custkey") % 13).alias("weight"))


def covered_hierarchy(spark, sf):
    """The hierarchy with cover levels by rule: customers 0..2, nations 1, so that levels part it."""
    s = structure(spark, sf, "hierarchy")
    lvl = F.when(F.col("edge_id") >= 3 * BASE, (F.col("edge_id") % 4 - 1)).otherwise(F.lit(1)).cast("int")
    return s, s.graph.edges.withColumn("cover_level", lvl)


def level_queries(spark, sf) -> DataFrame:
    return customer_pairs(spark, sf).withColumn("level", (F.col("qid") % 3).cast("int"))


def event_log(spark, sf) -> DataFrame:
    """The events as a log: an error removes an earlier edge, a signup a vertex for good, all others link. Many removals are stale."""
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "event_type", "user_id")
    op = F.when(F.col("event_type") == "error", "remove_edge").when(F.col("event_type") == "signup", "remove_vertex").otherwise("link")
    return e.select(F.col("event_id").alias("seq"), op.alias("op"), F.when(op == "remove_edge", F.floor(F.col("event_id") * 7 / 8)).otherwise(F.col("event_id")).cast("long").alias("edge_id"),
                    F.when(op == "remove_vertex", F.col("event_id") % 9973 + 100).otherwise((F.col("event_id") * 31 + F.col("user_id")) % 2003).cast("long").alias("u"), ((F.col("event_id") * 17) % 1999).cast("long").alias("v"))


def epochs(spark, sf) -> DataFrame:
    """Ten places of the log, each asked about a pair for every user."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    m = e.agg(F.max("event_id").alias("m"))
    u = e.select("user_id").distinct().crossJoin(F.broadcast(m)).select("user_id", "m", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("k"))
    return u.select((F.col("user_id") * 10 + F.col("k")).alias("qid"), F.floor(F.col("m") * F.col("k") / 10).cast("long").alias("t"), (F.col("user_id") * 3 % 2003).alias("u"), (F.col("user_id") * 5 % 1999).alias("v"))


def event_map(spark, sf) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("key"), F.floor(F.col("value") * 100).cast("long").alias("value"))


def event_ranges(spark, sf) -> DataFrame:
    """All pairs of kinds of ends, around every user."""
    kinds = F.array(*[F.lit(k) for k in ("included", "excluded", "unbounded")])
    u = spark.read.parquet(f"{sf}/events.parquet").select("user_id").distinct()
    r = u.select("user_id", F.posexplode(kinds).alias("a", "lo_kind")).select("*", F.posexplode(kinds).alias("b", "hi_kind"))
    return r.select((F.col("user_id") * 9 + F.col("a") * 3 + F.col("b")).cast("long").alias("rid"), (F.col("user_id") * 40).cast("long").alias("lo"), "lo_kind", (F.col("user_id") * 60 - 100).cast("long").alias("hi"), "hi_kind")


def _ps(spark, sf):
    return structure(spark, sf, "part_supplier")


def _op(spark, sf):
    return structure(spark, sf, "order_part")


def q_bridges(spark, sf):
    s = _op(spark, sf)
    b = s.bridges().join(s.comp.select(F.col("vertex_id").alias("u"), "component_id", "size"), "u")
    return b.select("edge_id", "u", "v", "component_id", F.col("size").alias("component_size"))


def q_endpoints(spark, sf):
    """Lines by number, past the last one too."""
    ids = spark.read.parquet(f"{sf}/part.parquet").select((F.col("p_partkey") * 41).alias("edge_id"))
    return _ps(spark, sf).graph.endpoints(ids)


def q_edges(spark, sf):
    return _ps(spark, sf).graph.edges.select("edge_id", "u", "v", "weight")


def q_degree(spark, sf):
    return _ps(spark, sf).graph.degree()


def q_parallel(spark, sf):
    return _ps(spark, sf).graph.multiplicity().where("copies > 1").select("u", "v", "copies", F.element_at("edge_ids", 1).alias("first_edge"))


def q_find_edges(spark, sf):
    s = _ps(spark, sf)
    pairs = s.graph.edges.select(F.col("v").alias("u"), F.col("u").alias("v")).distinct()
    return s.find_edges(pairs)


def q_incident(spark, sf):
    return _ps(spark, sf).incident_non_tree()


def q_connected(spark, sf):
    return _op(spark, sf).connected(order_pairs(spark, sf)).select("qid", "connected")


def q_component_size(spark, sf):
    return _op(spark, sf).component_size()


def q_component_of(spark, sf):
    s = _op(spark, sf)
    return s.members(s.comp.select("vertex_id"))


def q_tree_edge_count(spark, sf):
    return structure(spark, sf, "customer_part").tree_edge_count()


def q_msf(spark, sf):
    return _ps(spark, sf).cover.select("edge_id", "is_tree", F.coalesce("cover_level", F.lit(0)).alias("level"))


def q_is_bridge(spark, sf):
    return _op(spark, sf).is_bridge()


def q_find_bridge(spark, sf):
    return _op(spark, sf).find_bridge()


def q_two_edge(spark, sf):
    return _op(spark, sf).two_edge_component_size()


def q_two_edge_connected(spark, sf):
    return _op(spark, sf).two_edge_connected(order_pairs(spark, sf)).select("qid", "two_edge_connected")


def q_bridge_between(spark, sf):
    s = _op(spark, sf)
    return P.bridge_between(s, order_pairs(spark, sf)).select("qid", "bridge", "cover_level")


def q_cover_component(spark, sf):
    return _op(spark, sf).cover_level()


def _h(spark, sf):
    s, pairs = structure(spark, sf, "hierarchy"), customer_pairs(spark, sf)
    return s, pairs, P.path_edges(s.rooted, pairs)


def q_min_covered(spark, sf):
    s, c = covered_hierarchy(spark, sf)
    return P.between(s.rooted, customer_pairs(spark, sf), c).select("qid", "cover_level", "min_edge")


def q_path_len(spark, sf):
    s = structure(spark, sf, "hierarchy")
    return P.len_sum_max(s.rooted, customer_pairs(spark, sf), s.graph.edges)


def q_path_lca(spark, sf):
    """Lowest common ancestors of customers; the root of a tree is its smallest vertex, a region."""
    s, pairs = structure(spark, sf, "hierarchy"), customer_pairs(spark, sf)
    return pairs.select("qid").join(P.path_folds(s.rooted, pairs), "qid", "left").select("qid", "lca", "path_len")


def q_path_ordered(spark, sf):
    s, pairs, steps = _h(spark, sf)
    got = P.fold(steps, pairs, s.graph.edges.select("edge_id", "weight"), e=P.ordered_edges())
    return got.select("qid", F.array_join("e", ",").alias("edges"))


def q_path_user(spark, sf):
    s, _, steps = _h(spark, sf)
    fold = PathAggregate(F.lit(0).cast("long"), lambda e: e["weight"], lambda a, b: (a * 31 + b) % 1000003)
    return fold.over(steps, s.graph.edges.select("edge_id", "weight"))


def q_component_fold(spark, sf):
    s = structure(spark, sf, "hierarchy")
    return component_fold(s.comp, s.graph.edges, customer_labels(spark, sf), n=NAMED["count"]("weight"), total=NAMED["sum"]("weight"), xored=NAMED["xor"]("weight"), least=NAMED["min"]("weight"), most=NAMED["max"]("weight"))


def q_label_fold(spark, sf):
    """Labels alone, folded over components."""
    s = structure(spark, sf, "hierarchy")
    return component_fold(s.comp, s.graph.edges.limit(0), customer_labels(spark, sf), n=F.count("weight"), total=F.sum("weight"))


def q_find_size(spark, sf):
    s, c = covered_hierarchy(spark, sf)
    return P.find_size(level_queries(spark, sf), s.rooted, c)


def q_first_label(spark, sf):
    s, c = covered_hierarchy(spark, sf)
    return P.find_first_label(level_queries(spark, sf), s.rooted, c, customer_labels(spark, sf))


def q_incident_mask(spark, sf):
    s, c = covered_hierarchy(spark, sf)
    return P.incident_mask(customer_pairs(spark, sf), s.rooted, c, customer_labels(spark, sf))


def q_point_mask(spark, sf):
    """The point form: both ends the same customer."""
    s, c = covered_hierarchy(spark, sf)
    return P.incident_mask(customer_pairs(spark, sf).withColumn("v", F.col("u")), s.rooted, c, customer_labels(spark, sf))


def q_tags(spark, sf):
    s, ops = structure(spark, sf, "hierarchy"), customer_updates(spark, sf)
    return C.fold_tags(s.graph.edges, ops, P.path_edges(s.rooted, ops))


def q_path_add(spark, sf):
    s = structure(spark, sf, "hierarchy")
    return C.add_on_paths(s.rooted, s.graph.edges, customer_updates(spark, sf))


def q_levels(spark, sf):
    x = spark.range(-4, 40).select(F.col("id").cast("int").alias("level"))
    return x.select("level", valid_level(F.col("level")).alias("valid"), next_level(F.col("level")).alias("following"), C.apply_tag(F.col("level"), C.compose(C.tag(F.lit("cover"), F.lit(7)), C.tag(F.lit("uncover"), F.lit(9)))).cast("int").alias("covered_then_not"), C.apply_tag(F.col("level"), C.identity_tag()).cast("int").alias("same")).withColumn("top", F.lit(MAX_LEVEL))


def q_tag_compositions(spark, sf):
    """Every two updates of levels -1 to 6, composed, on every probe; the largest int is no path."""
    n = spark.range(16)
    two = n.select(F.col("id").alias("i")).crossJoin(n.select(F.col("id").alias("j")))  # 256 rows
    probes = F.array(*[F.lit(x).cast("int") for x in (-1, 0, 1, 3, 5, 6, 32, 2147483647)])
    tag = lambda c: C.tag(F.when(F.col(c) >= 8, "uncover").otherwise("cover"), (F.col(c) % 8 - 1).cast("int"))
    return two.select("i", "j", F.explode(probes).alias("probe")).select("i", "j", "probe", C.apply_tag(F.col("probe"), C.compose(tag("i"), tag("j"))).cast("int").alias("after"))


def q_size_vectors(spark, sf):
    """Customers of each region's tree by cover level of their edge, up to level 1."""
    s, c = covered_hierarchy(spark, sf)
    sizes = c.where(f"edge_id >= {3 * BASE}").select(F.col("u").alias("vertex_id"), F.col("cover_level").alias("level"), F.lit(1).alias("size")).join(s.comp.select("vertex_id", "component_id"), "vertex_id")
    return C.masked(C.size_vector_sum(sizes, "component_id"), 1).select("component_id", "level", "size")


def q_part_entries(spark, sf):
    """Both halves of the monoid of parts: sizes by level and the levels of labels, by tree."""
    s, c = covered_hierarchy(spark, sf)
    at = s.comp.select("vertex_id", "component_id")
    sizes = c.where(f"edge_id >= {3 * BASE}").select(F.col("u").alias("vertex_id"), F.col("cover_level").alias("level"), F.lit(1).alias("size")).join(at, "vertex_id")
    masks = customer_labels(spark, sf).join(at, "vertex_id").select("component_id", F.expr("shiftleft(1L, level + 1)").alias("mask"))
    got = C.part_entries(sizes, masks, "component_id")
    return got.select("component_id", F.array_join(F.transform(F.array_sort(F.map_entries("sizes")), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ",").alias("sizes"), "mask")


def q_range_bounds(spark, sf):
    return M.range_sums(event_map(spark, sf), event_ranges(spark, sf))


def q_range_fold(spark, sf):
    """Largest value of each range; none is null."""
    return M.range_fold(event_map(spark, sf), event_ranges(spark, sf), F.col("value"), F.max).withColumnRenamed("value", "most")


def q_range_scan(spark, sf):
    """The middle half of the keys, from the last to the first."""
    kv = event_map(spark, sf)
    lo, hi = kv.agg(F.min("key"), F.max("key")).first()
    lo, hi = lo or 0, hi or 0
    return M.scan(kv, lo + (hi - lo) // 4, "included", lo + 3 * (hi - lo) // 4, "excluded", descending=True)


def q_upsert(spark, sf):
    kv = event_map(spark, sf)
    new = kv.where("key >= 500").select((F.col("key") + 500).alias("key"), (-F.col("value")).alias("value"))
    return M.upsert(kv, new, lambda a, b: a + b)


def event_map_log(spark, sf) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "remove").otherwise("insert").alias("op"), (F.col("event_id") * 7919 % 200).alias("key"), F.col("event_id").alias("value"))


def q_map_log(spark, sf):
    return M.replay(event_map_log(spark, sf))


def q_map_insert(spark, sf):
    """What every insert and remove of the log returns."""
    return M.previous(event_map_log(spark, sf))


def q_map_totals(spark, sf):
    kv = event_map(spark, sf)
    one = M.totals(kv, total=F.sum("value"), least=F.min("value"), most=F.max("value"))
    none = M.totals(M.clear(kv), total=F.sum("value"), least=F.min("value"), most=F.max("value"))
    same, other = M.equal(kv, M.upsert(kv, kv)), M.equal(kv, M.pop_first(kv)[1])
    return one.withColumn("of", F.lit("all")).unionByName(none.withColumn("of", F.lit("cleared"))).withColumn("equal_to_itself", F.lit(same)).withColumn("equal_without_first", F.lit(other))


def _asked_keys(kv: DataFrame) -> DataFrame:
    """Every key moved on by 100: most are there, the last are not."""
    return kv.select((F.col("key") + 100).alias("key"))


def q_map_get(spark, sf):
    kv = event_map(spark, sf)
    return M.get(kv, _asked_keys(kv))


def q_map_or_insert(spark, sf):
    kv = event_map(spark, sf)
    return M.or_insert(kv, _asked_keys(kv), F.col("key") * 2)


def q_map_or_default(spark, sf):
    kv = event_map(spark, sf)
    return M.or_default(kv, _asked_keys(kv))


def q_map_and_modify(spark, sf):
    kv = event_map(spark, sf)
    return M.and_modify(kv, _asked_keys(kv), lambda v: v * 3 + 1)


def q_map_update_or_insert(spark, sf):
    kv = event_map(spark, sf)
    return M.update_or_insert_with(kv, _asked_keys(kv), lambda v: v + 7, F.lit(-5).cast("long"))


def q_map_update(spark, sf):
    """Values below 0 or over 10,000 set to their key; keys from 9,000 on removed."""
    kv = event_map(spark, sf)
    return M.remove(M.update(kv, (F.col("value") < 0) | (F.col("value") > 10_000), F.col("key")), kv.where("key >= 9000"))


def q_map_ends(spark, sf):
    """First and last key and value in key order, from both ends."""
    kv = event_map(spark, sf)
    ends = [("keys", M.keys(kv), M.keys(kv, True), "key"), ("values", M.values(kv), M.values(kv, True), "value")]
    out = None
    for name, up, down, c in ends:
        row = up.limit(1).select(F.lit(name).alias("what"), F.col(c).alias("front")).crossJoin(down.limit(1).select(F.col(c).alias("back")))  # one row each
        out = row if out is None else out.unionByName(row)
    return out


def q_first_last(spark, sf):
    kv = event_map(spark, sf)
    (a, rest), (b, _) = M.pop_first(kv), M.pop_last(kv)
    return a.withColumn("which", F.lit("first")).unionByName(M.first(rest).withColumn("which", F.lit("second"))).unionByName(b.withColumn("which", F.lit("last")))


def q_as_of(spark, sf):
    return L.as_of_connected(event_log(spark, sf), epochs(spark, sf))


def q_removed_bridges(spark, sf):
    return L.removed_bridges(event_log(spark, sf))


def q_removed_vertices(spark, sf):
    got = L.removed_vertices(event_log(spark, sf))
    return got.select("seq", "vertex_id", F.array_join("parts", ",").alias("parts"))


def q_edge_lives(spark, sf):
    return L.edge_lives(event_log(spark, sf))


def q_snapshot(spark, sf):
    """The edges that live after half of the log."""
    log = event_log(spark, sf)
    half = (log.agg(F.max("seq")).first()[0] or 0) // 2
    return L.snapshot(log, half).edges.select("edge_id", "u", "v")


def _hubs(spark, sf):
    return spark.read.parquet(f"{sf}/supplier.parquet").where("s_suppkey <= 10").select((2 * F.col("s_suppkey") + 1).alias("vertex_id"))


def q_without_hubs(spark, sf):
    """Removal of the ten smallest suppliers as a change of sets."""
    return graph(spark, sf, "part_supplier").remove_vertices(_hubs(spark, sf)).degree()


def _all_vertices(spark, sf) -> Graph:
    """The part-supplier graph with a vertex for each part and supplier, and for as many that have no line."""
    p = spark.read.parquet(f"{sf}/part.parquet").select((2 * F.col("p_partkey")).alias("vertex_id"))
    s = spark.read.parquet(f"{sf}/supplier.parquet").select((2 * F.col("s_suppkey") + 1).alias("vertex_id"))
    lone = p.select((F.col("vertex_id") + 10**7).alias("vertex_id"))
    return graph(spark, sf, "part_supplier").add_vertices(p.unionByName(s).unionByName(lone))


def q_add_vertices(spark, sf):
    return _all_vertices(spark, sf).vertices


def q_remove_isolated(spark, sf):
    """Every part is asked to go, with its lone twin: only those without lines do."""
    g = _all_vertices(spark, sf)
    ids = spark.read.parquet(f"{sf}/part.parquet").select(F.explode(F.array(2 * F.col("p_partkey"), 2 * F.col("p_partkey") + 10**7)).alias("vertex_id"))
    left, refused = g.remove_isolated_vertices(ids)
    return left.vertices.join(refused.select("vertex_id", F.lit(True).alias("refused")), "vertex_id", "left").select("vertex_id", F.coalesce("refused", F.lit(False)).alias("refused"))


def _new_edges(spark, sf) -> DataFrame:
    """An edge for every part to a supplier that may not be there, and a self-loop for every tenth."""
    p = spark.read.parquet(f"{sf}/part.parquet")
    v = F.when(F.col("p_partkey") % 10 == 0, 2 * F.col("p_partkey")).otherwise(2 * (F.col("p_partkey") % 150) + 1)
    return p.select((F.col("p_partkey") + 10**9).alias("edge_id"), (2 * F.col("p_partkey")).alias("u"), v.alias("v"), F.lit(1).cast("long").alias("weight"), (F.col("p_partkey") + 10**9).alias("seq"))


def q_link(spark, sf):
    return _all_vertices(spark, sf).link(_new_edges(spark, sf)).edges.where("edge_id >= 1000000000").select("edge_id", "u", "v")


def q_self_loops(spark, sf):
    return split_self_loops(_new_edges(spark, sf))[1].select("edge_id", "u")


def q_remove_edges(spark, sf):
    """The lines of even number removed."""
    g = graph(spark, sf, "part_supplier")
    return g.remove_edges(g.edges.where("edge_id % 2 = 0")).edges.select("edge_id", "u", "v")


def _cut_pairs(spark, sf) -> DataFrame:
    """Every part with the supplier of its own number, most often no edge."""
    return spark.read.parquet(f"{sf}/part.parquet").select((2 * (F.col("p_partkey") % 100) + 1).alias("u"), (2 * F.col("p_partkey")).alias("v"))


def q_cut(spark, sf):
    """What a cut takes away, with its payload."""
    return graph(spark, sf, "part_supplier").cut_edges(_cut_pairs(spark, sf)).select("edge_id", "u", "v", "weight")


def q_cut_left(spark, sf):
    return graph(spark, sf, "part_supplier").cut(_cut_pairs(spark, sf)).degree()


def q_forest_link(spark, sf):
    """Edges between customers offered to the hierarchy: those that would close a cycle are refused."""
    s = structure(spark, sf, "hierarchy")
    new = customer_pairs(spark, sf).select((F.col("qid") + 4 * BASE).alias("edge_id"), "u", "v", F.lit(1).cast("long").alias("weight"), F.col("qid").alias("seq"))
    taken, refused = forest_link(s.graph, s.comp, new)
    return taken.edges.where(f"edge_id >= {4 * BASE}").select("edge_id", F.lit(True).alias("taken")).unionByName(refused.select("edge_id", F.lit(False).alias("taken")))


def label_log(spark, sf) -> DataFrame:
    """A label for every customer, updated by every third, detached by every fifth; every seventh is detached before it is attached."""
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("k"))
    ops = F.array(
        F.when(F.col("k") % 7 == 0, F.struct(F.lit(0).alias("p"), F.lit("detach").alias("op"))), F.struct(F.lit(1).alias("p"), F.lit("attach").alias("op")),
        F.when(F.col("k") % 3 == 0, F.struct(F.lit(2).alias("p"), F.lit("update_label").alias("op"))), F.when(F.col("k") % 5 == 0, F.struct(F.lit(3).alias("p"), F.lit("detach").alias("op"))),
        F.when(F.col("k") % 6 == 0, F.struct(F.lit(4).alias("p"), F.lit("update_label").alias("op"))))
    rows = c.select("k", F.explode(F.filter(ops, lambda o: o.isNotNull())).alias("o"))
    return rows.select((F.col("k") * 5 + F.col("o.p")).alias("seq"), F.col("o.op").alias("op"), F.col("k").alias("label_id"), (F.col("k") % 500 + 3 * BASE).alias("vertex_id"), (F.col("k") % 4).cast("int").alias("level"), (F.col("k") * 10 + F.col("o.p")).alias("weight"))


def q_label_log(spark, sf):
    return B.replay(label_log(spark, sf))


def q_label_changes(spark, sf):
    """Attached, detached and updated as sets: labels of the hierarchy, new ones for all customers, old ones of even number gone, every third weight replaced."""
    s, old = structure(spark, sf, "hierarchy"), customer_labels(spark, sf)
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("k"))
    new = c.select((F.col("k") + 10**6).alias("label_id"), (F.col("k") + 3 * BASE + F.when(F.col("k") % 9 == 0, BASE).otherwise(0)).alias("vertex_id"), F.lit(0).alias("level"), F.col("k").alias("weight"))
    got = B.detach(B.attach(s.graph, old, new), old.where("label_id % 2 = 0"))
    return B.update_label(got, c.where("k % 3 = 0").select((F.col("k") + 10**6).alias("label_id"), (-F.col("k")).alias("weight")))


def q_label_vertex(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("label_id"))
    return B.label_vertex(customer_labels(spark, sf), c)


def q_first_label_at(spark, sf):
    return B.first_label(B.replay(label_log(spark, sf)), structure(spark, sf, "hierarchy").graph.vertices)


def q_into_vertex(spark, sf):
    """Ids of labels and of vertices, told apart by the table they are in."""
    s = structure(spark, sf, "hierarchy")
    ids = s.graph.vertices.select(F.col("vertex_id").alias("id")).unionByName(spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("id")))
    return B.into_vertex(customer_labels(spark, sf), ids)


def q_leaf_payloads(spark, sf):
    s = structure(spark, sf, "hierarchy")
    return B.payloads(B.leaves(s.graph, customer_labels(spark, sf)))


def q_incident_leaves(spark, sf):
    s = structure(spark, sf, "hierarchy")
    return B.incident_leaves(s.graph, customer_labels(spark, sf))


def q_leaf_ranges(spark, sf):
    s = structure(spark, sf, "hierarchy")
    return B.leaf_ranges(s.comp, B.leaves(s.graph, customer_labels(spark, sf)))


def q_degrees(spark, sf):
    s = structure(spark, sf, "hierarchy")
    return B.degrees(s.graph, customer_labels(spark, sf), 3)


def q_counts(spark, sf):
    s = structure(spark, sf, "hierarchy")
    return B.counts(s.graph, customer_labels(spark, sf))


QUERIES = {
    "bridges": q_bridges, "edges": q_edges, "edges_endpoints": q_endpoints, "degree": q_degree, "parallel_pairs": q_parallel, "find_edge_by_endpoints": q_find_edges, "incident_edges": q_incident,
    "connected_pairs": q_connected, "component_size": q_component_size, "component_of": q_component_of, "tree_edge_count": q_tree_edge_count, "spanning_forest_msf": q_msf, "is_bridge": q_is_bridge, "find_bridge_vertex": q_find_bridge,
    "two_edge_components": q_two_edge, "two_edge_connected_pairs": q_two_edge_connected, "find_bridge_between": q_bridge_between, "cover_level_component": q_cover_component, "min_covered_edge_between": q_min_covered,
    "path_len_sum_max": q_path_len, "path_lca": q_path_lca, "path_edges_ordered": q_path_ordered, "path_user_fold": q_path_user, "component_fold": q_component_fold, "label_fold": q_label_fold, "find_size_levels": q_find_size, "find_first_label": q_first_label, "incident_mask": q_incident_mask, "point_incident_mask": q_point_mask,
    "cover_uncover_fold": q_tags, "path_tag_add": q_path_add, "level_algebra": q_levels, "tag_compositions": q_tag_compositions, "size_vectors": q_size_vectors, "part_entries": q_part_entries,
    "range_aggregate_bounds": q_range_bounds, "range_fold": q_range_fold, "range_scan": q_range_scan, "map_upsert": q_upsert, "map_log": q_map_log, "map_insert_returns": q_map_insert, "map_totals": q_map_totals, "map_get": q_map_get, "map_or_insert": q_map_or_insert, "map_or_default": q_map_or_default,
    "map_and_modify": q_map_and_modify, "map_update_or_insert": q_map_update_or_insert, "map_update_remove": q_map_update, "map_ends": q_map_ends, "first_last_key": q_first_last,
    "as_of_connected": q_as_of, "remove_edge_snapshot": q_removed_bridges, "remove_vertex_snapshot": q_removed_vertices, "edge_lives": q_edge_lives, "snapshot_edges": q_snapshot, "vertex_removal": q_without_hubs,
    "add_vertices": q_add_vertices, "remove_isolated_vertices": q_remove_isolated, "link": q_link, "self_loops": q_self_loops, "remove_edges": q_remove_edges, "cut_edges": q_cut, "cut_degrees": q_cut_left, "forest_link": q_forest_link,
    "label_log": q_label_log, "label_changes": q_label_changes, "label_vertex": q_label_vertex, "first_label_at": q_first_label_at, "into_vertex": q_into_vertex, "leaf_payloads": q_leaf_payloads, "incident_leaves": q_incident_leaves, "leaf_ranges": q_leaf_ranges, "degrees": q_degrees, "counts": q_counts,
}
