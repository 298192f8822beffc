import os
import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import components, cover as C, oplog as L, ordered_map as M, paths as P
from graphloom.operators.graph import Graph
from graphloom.operators.structure import derive

GRAPHS = {
    "path": (6, "01 12 23 34 45", [0, 1, 2, 3, 4]),
    "triangles": (7, "01 12 20 23 34 45 53", [3]),
    "parallel": (6, "01 01 12 23 34 42", [2]),
    "chords": (5, "01 12 23 30 02 13", []),
    "apart": (7, "01 12 34 45 53", [0, 1]),
    "tails": (8, "01 12 20 23 45 56", [3, 4, 5]),
    "overlapping": (5, "01 12 02 23 03 24 04", []),
    "doubled": (3, "01 01 02 21", []),
    "joined": (8, "01 12 23 45 56 67 15", [0, 1, 2, 3, 4, 5, 6]),
}


def make(spark, n, pairs):
    e = [(i, int(p[0]), int(p[1])) for i, p in enumerate(pairs)]
    v = spark.createDataFrame([(i,) for i in range(n)], "vertex_id long")
    return Graph.of_edges(spark.createDataFrame(e, "edge_id long, u long, v long"), v)


def brute(n, edges):
    def comps(live):
        c = list(range(n))
        for _ in range(n):
            for _, u, v in live:
                c[u] = c[v] = min(c[u], c[v])
        return c

    whole = comps(edges)
    bridges = {e[0] for e in edges if comps([x for x in edges if x[0] != e[0]]) != whole}
    tree, c = set(), list(range(n))
    for e, u, v in edges:
        if c[u] != c[v]:
            tree.add(e)
            a, b = c[u], c[v]
            c = [min(a, b) if x in (a, b) else x for x in c]
    return whole, bridges, tree, comps([e for e in edges if e[0] not in bridges])


@pytest.mark.parametrize("rounds", [False, True])
def test_fixtures_and_random_graphs_by_both_kernels(spark, rounds, monkeypatch):
    """All fixtures and a few random multigraphs as one graph, each moved to vertices of its own."""
    monkeypatch.setattr(components, "FEW", 0 if rounds else 100_000)
    rng = random.Random(0x5EEDCAFE)
    all_edges, n = [], 0
    for size, pairs, _ in GRAPHS.values():
        all_edges += [(n + int(p[0]), n + int(p[1])) for p in pairs.split()]
        n += size
    for _ in range(4):
        size = rng.randint(8, 12)
        ends = [rng.sample(range(size), 2) for _ in range(rng.randint(4, 14))]
        all_edges += [(n + u, n + v) for u, v in ends]
        n += size
    edges = [(i, u, v) for i, (u, v) in enumerate(all_edges)]
    g = Graph.of_edges(spark.createDataFrame(edges, "edge_id long, u long, v long"), spark.range(n).withColumnRenamed("id", "vertex_id"))
    s = derive(g, most_edges=0 if rounds else 10**6)
    comp, bridges, tree, block = brute(n, edges)
    assert {r.vertex_id: r.component_id for r in s.comp.collect()} == dict(enumerate(comp))
    cover = {r.edge_id: r for r in s.cover.collect()}
    assert {e for e, r in cover.items() if r.is_bridge} == bridges
    assert {e for e, r in cover.items() if r.is_tree} == tree
    assert {r.vertex_id: r.block for r in s.forest.collect()} == dict(enumerate(block))
    assert s.tree_edge_count().first()[0] == n - len(set(comp))


def test_fixture_bridges(spark):
    size, pairs, want = GRAPHS["triangles"]
    s = derive(make(spark, size, pairs.split()))
    assert [r.edge_id for r in s.bridges().collect()] == want
    asked = spark.createDataFrame([(6, 6), (6, 0), (0, 5), (0, 99)], "u long, v long")
    assert {(r.u, r.v): r.connected for r in s.connected(asked).collect()} == {(6, 6): True, (6, 0): False, (0, 5): True, (0, 99): False}


def test_self_loops_are_rejected(spark):
    g = Graph.of_edges(spark.createDataFrame([(0, 0, 0)], "edge_id long, u long, v long"))
    assert g.edges.count() == 0 and g.vertices.count() == 1


def test_empty_graph(spark):
    s = derive(Graph.empty(spark))
    assert s.comp.count() == 0 and s.bridges().count() == 0 and s.tree_edge_count().first()[0] == 0


@pytest.mark.parametrize("most", [0, 10**6])
def test_paths_by_both_ways(spark, most):
    n = 40
    rng = random.Random(3)
    up = [(i, rng.randrange(max(0, i - 4), i), i) for i in range(1, n)]
    s = derive(Graph.of_edges(spark.createDataFrame([(e, u, v) for e, u, v in up], "edge_id long, u long, v long")))
    parent = {v: (u, e) for e, u, v in up}
    pairs = [(q, rng.randrange(n), rng.randrange(n)) for q in range(60)]
    df = spark.createDataFrame(pairs, "qid long, u long, v long")
    got = {}
    for r in P.path_edges(s.forest, df, most).orderBy("qid", "pos").collect():
        got.setdefault(r.qid, []).append(r.edge_id)

    def root(x):
        out = []
        while x in parent:
            out.append(parent[x][1])
            x = parent[x][0]
        return out

    for q, u, v in pairs:
        a, b = root(u), root(v)
        while a and b and a[-1] == b[-1]:
            a, b = a[:-1], b[:-1]
        assert got.get(q, []) == a + b[::-1]


def test_cover_tags(spark):
    """Four logs, each on an edge of its own."""
    logs = (("c2", 2), ("c2 u2", -1), ("c2 u2 c4", 4), ("c2 u2 c4 u3", 4))
    s = derive(Graph.of_edges(spark.createDataFrame([(k, 10 * k, 10 * k + 1) for k in range(4)], "edge_id long, u long, v long")))
    ops = spark.createDataFrame([(10 * k + i, 10 * k, 10 * k + 1, "cover" if o[0] == "c" else "uncover", int(o[1:])) for k, (log, _) in enumerate(logs) for i, o in enumerate(log.split())], "seq long, u long, v long, op string, level int")
    steps = P.path_edges(s.forest, ops.withColumn("qid", F.col("seq")))
    assert {r.edge_id: r.cover_level for r in C.fold_tags(s.graph.edges, ops, steps).collect()} == {k: want for k, (_, want) in enumerate(logs)}


def test_ordered_map_ranges(spark):
    kv = spark.createDataFrame([(k, k * k - 30) for k in range(40)], "key long, value long")
    kinds, rows = ("included", "excluded", "unbounded"), []
    for lo in range(-5, 45, 7):
        for hi in range(-5, 45, 6):
            rows += [(len(rows) + 9 * i + j, lo, a, hi, b) for i, a in enumerate(kinds) for j, b in enumerate(kinds)]
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    r = spark.createDataFrame(rows, "rid long, lo long, lo_kind string, hi long, hi_kind string")
    got = {x.rid: (x.total, x.n) for x in M.range_sums(kv, r).collect()}
    for i, lo, a, hi, b in rows:
        inside = [k for k in range(40) if (a == "unbounded" or k > lo or a == "included" and k == lo) and (b == "unbounded" or k < hi or b == "included" and k == hi)]
        assert got[i] == (sum(k * k - 30 for k in inside), len(inside)), (lo, a, hi, b)


def test_op_log_and_stream(spark, tmp_path):
    from graphloom.schema import OP_LOG
    from graphloom.streaming.maintain import Maintainer

    ops = [(1, "link", 1, 0, 1), (2, "link", 2, 0, 1), (3, "link", 3, 1, 2), (4, "remove_edge", 2, None, None), (5, "link", 5, 2, 3), (6, "remove_edge", 1, None, None), (7, "link", 7, 0, 3), (8, "remove_vertex", None, 2, None), (9, "link", 9, 2, 1)]
    log = spark.createDataFrame([(s, o, e, u, v, None, None) for s, o, e, u, v in ops], OP_LOG)
    assert {r.seq: r.was_bridge for r in L.removed_bridges(log).collect()} == {4: False, 6: True}
    assert [tuple(r) for r in L.removed_vertices(log).collect()] == [(8, 2, [1, 3])]
    q = spark.createDataFrame([(1, 5, 0, 3), (2, 6, 0, 3), (3, 7, 0, 3), (4, 9, 1, 3), (5, 9, 2, 2)], "qid long, t long, u long, v long")
    assert {r.qid: r.connected for r in L.as_of_connected(log, q).collect()} == {1: True, 2: False, 3: True, 4: False, 5: False}
    src = str(tmp_path / "in")
    for i in range(0, len(ops), 3):
        log.where((F.col("seq") > i) & (F.col("seq") <= i + 3)).coalesce(1).write.mode("append").parquet(src)
    m = Maintainer(spark, str(tmp_path / "state"))
    stream = spark.readStream.schema(OP_LOG).option("maxFilesPerTrigger", 1).parquet(src)
    run = m.run(stream, str(tmp_path / "ck"))
    run.processAllAvailable()
    run.stop()
    want = {r.vertex_id: r.component_id for r in derive(L.snapshot(log, 9)).comp.collect()}
    assert {r.vertex_id: r.component_id for r in m.components().collect()} == want == {0: 0, 1: 1, 3: 0}


def test_entry_without_llm():
    import __spark_entry__ as E

    assert {"bridges", "find_size_levels"} <= set(E.queries()) and set(E.oracle_sql()) <= set(E.queries())


def test_discard_deletes_scratch_tables_only(spark, tmp_path):
    from graphloom.sources.scratch import discard, materialize, materialize_bucketed

    kept = str(tmp_path / "kept")
    spark.range(5).write.parquet(kept)
    for table in (materialize(spark.range(5), "plain"), materialize_bucketed(spark.range(5), "bucketed", "id", 2)):
        paths = [f.removeprefix("file:").replace("///", "/") for f in table.inputFiles()]
        assert paths and all(os.path.exists(p) for p in paths)
        discard(table)
        assert not any(os.path.exists(p) for p in paths)
    discard(materialize(spark.range(0), "empty"))
    discard(spark.read.parquet(kept))
    assert spark.read.parquet(kept).count() == 5


def test_range_folds_and_ends_beyond_all_bounds(spark):
    big = 2**62
    kv = spark.createDataFrame([(-(2**63), 1), (0, 10), (big + 5, 100), (2**63 - 1, None)], "key long, value long")
    rows = [(1, None, "unbounded", None, "unbounded"), (2, big, "excluded", None, "unbounded"), (3, 5, "included", 5, "excluded"), (4, 9, "included", -9, "included"), (5, None, "unbounded", 0, "included"), (6, 2**63 - 1, "included", 2**63 - 1, "included")]
    r = spark.createDataFrame(rows, "rid long, lo long, lo_kind string, hi long, hi_kind string")
    assert {(x.rid, x.total, x.n) for x in M.range_sums(kv, r).collect()} == {(1, 111, 4), (2, 100, 2), (3, 0, 0), (4, 0, 0), (5, 11, 2), (6, 0, 1)}
    assert {(x.rid, x.value) for x in M.range_fold(kv, r, F.col("value"), F.max, F.lit(0).cast("long")).collect()} == {(1, 100), (2, 100), (3, 0), (4, 0), (5, 10), (6, 0)}
    words = spark.createDataFrame([("ant", 1), ("bee", 2), ("cat", 4)], "key string, value long")
    r = spark.createDataFrame([(1, "b", "included", "d", "excluded")], "rid long, lo string, lo_kind string, hi string, hi_kind string")
    assert M.range_sums(words, r).first().total == 6
    assert M.range_sums(kv.limit(0), r.selectExpr("rid", "1L lo", "lo_kind", "2L hi", "hi_kind")).first().total == 0


def test_range_folds_by_brute_force(spark):
    rng = random.Random(5)
    kv = spark.createDataFrame([(k * 3, rng.randrange(1000)) for k in range(53)], "key long, value long")
    have = {r.key: r.value for r in kv.collect()}
    rows = [(i, rng.randrange(-5, 170), rng.choice(["included", "excluded", "unbounded"]), rng.randrange(-5, 170), rng.choice(["included", "excluded", "unbounded"])) for i in range(150)]
    r = spark.createDataFrame(rows, "rid long, lo long, lo_kind string, hi long, hi_kind string")
    got = {x.rid: x.value for x in M.range_fold(kv, r, F.col("value"), F.min).collect()}
    for i, lo, a, hi, b in rows:
        inside = [v for k, v in have.items() if (a == "unbounded" or k > lo or a == "included" and k == lo) and (b == "unbounded" or k < hi or b == "included" and k == hi)]
        assert got[i] == (min(inside) if inside else None)


def test_null_values_are_entries(spark):
    kv = spark.createDataFrame([(1, None), (2, 5)], "key long, value long")
    k = spark.createDataFrame([(1,), (3,)], "key long")
    rows = lambda df: {tuple(r) for r in df.collect()}
    assert rows(M.or_insert(kv, k, F.lit(9).cast("long"))) == {(1, None), (2, 5), (3, 9)}
    assert rows(M.upsert(kv, k.withColumn("value", F.lit(None).cast("long")), lambda a, b: F.coalesce(a, F.lit(7)))) == {(1, 7), (2, 5), (3, None)}
    assert rows(M.and_modify(kv, k, lambda v: F.coalesce(v, F.lit(0)) + 1)) == {(1, 1), (2, 5)}
    assert rows(M.or_default(kv, k)) == {(1, None), (2, 5), (3, 0)} and rows(M.get(kv, k)) == {(1, True, None), (3, False, None)}
    assert M.equal(kv, kv) and not M.equal(kv, M.remove(kv, k)) and not M.equal(kv, kv.withColumn("value", F.lit(0).cast("long")))


def test_a_long_path_takes_few_rounds(spark):
    """A path of 12,000 edges without the pass over a component: every edge is a bridge, depths run to the end."""
    from graphloom.operators import structure as S

    n = 12_000
    e = spark.range(n).select(F.col("id").alias("edge_id"), F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    s = derive(Graph.of_edges(e), most_edges=0)
    assert s.forest.agg(F.max("depth")).first()[0] == n and s.bridges().count() == n
    assert s.forest.where("depth <> vertex_id").isEmpty()
    asked = spark.createDataFrame([(1, 0, n), (2, 5000, 11), (3, 77, 77), (4, 3, n + 9)], "qid long, u long, v long")
    got = {r.qid: (r.path_len, r.path_sum, r.path_max) for r in P.len_sum_max(s.forest, asked, s.graph.edges.withColumn("weight", F.col("edge_id"))).collect()}
    assert got == {1: (n, n * (n - 1) // 2, n - 1), 2: (4989, sum(range(11, 5000)), 4999), 3: (0, 0, 0), 4: (None, None, None)}
    assert S.MOST_EDGES < 2**31


@pytest.mark.parametrize("most", [0])
def test_path_answers_by_brute_force(spark, most):
    """Sizes, first labels, masks, covers and additions on a random forest against their definitions."""
    rng = random.Random(17)
    n = 26
    parent = {i: rng.randrange(max(0, i - 3), i) for i in range(1, n) if i != 14}
    edges = [(100 + i, i, p, rng.randrange(1, 9)) for i, p in parent.items()]
    s = derive(Graph.of_edges(spark.createDataFrame(edges, "edge_id long, u long, v long, weight long"), spark.range(n + 1).withColumnRenamed("id", "vertex_id")), most_edges=most)
    level = {100 + i: rng.choice([-1, 0, 1, 2]) for i in parent}
    lv = spark.createDataFrame(list(level.items()), "edge_id long, cover_level int")
    cover = s.cover.drop("cover_level").join(lv, "edge_id")
    labels = [(i, rng.randrange(n), rng.choice([0, 1, 2])) for i in range(12)]
    near = {i: [] for i in range(n + 1)}
    for i, p in parent.items():
        near[i].append((p, 100 + i))
        near[p].append((i, 100 + i))

    def path(a, b):
        seen = {a: (None, None)}
        todo = [a]
        for x in todo:
            for y, e in near[x]:
                if y not in seen:
                    seen[y] = (x, e)
                    todo.append(y)
        if b not in seen:
            return None
        out = [(b, None)]
        while out[-1][0] != a:
            x, e = seen[out[-1][0]]
            out[-1] = (out[-1][0], e)
            out.append((x, None))
        return out[::-1]  # (vertex, edge before it)

    def low(p):
        return min((level[e] for _, e in p if e is not None), default=99)

    qs = [(q, rng.randrange(n + 1), rng.randrange(n + 1), rng.choice([0, 1, 2])) for q in range(60)]
    df = spark.createDataFrame(qs, "qid long, u long, v long, level int")
    lab = spark.createDataFrame([(i, x, l, 0) for i, x, l in labels], "label_id long, vertex_id long, level int, weight long")
    size = {r.qid: r.size for r in P.find_size(df, s.forest, cover).collect()}
    label = {r.qid: r.label_id for r in P.find_first_label(df, s.forest, cover, lab).collect()}
    mask = {r.qid: r.mask for r in P.incident_mask(df, s.forest, cover, lab).collect()}
    least = {r.qid: (r.cover_level, r.min_edge) for r in P.between(s.forest, df, cover).collect()}
    for q, u, v, l in qs:
        p = path(u, v)
        if p is None:
            assert (size[q], label[q], mask[q], least[q]) == (0, None, 0, (2147483647, None))
            continue
        on = [x for x, _ in p]
        meet = {x: min(((len(r), on.index(r[0][0]), r) for y in on if (r := path(y, x)) is not None), key=lambda z: z[0]) for x in range(n) if path(u, x)}
        assert size[q] == sum(low(m[2]) >= l for m in meet.values())
        cand = [(m[1], x, i) for i, x, k in labels if k == l and (m := meet.get(x)) and low(m[2]) >= l]
        assert label[q] == (min(cand)[2] if cand else None)
        assert mask[q] == sum({1 << (k + 1) for i, x, k in labels if (m := meet.get(x)) and low(m[2]) >= k})
        es = [e for _, e in p if e is not None]
        assert least[q] == (min((level[e], e) for e in es) if es else (2147483647, None))
    ops = spark.createDataFrame([(q, u, v, q + 1) for q, u, v, _ in qs], "seq long, u long, v long, x long")
    plus = {e: w + sum(q + 1 for q, u, v, _ in qs if (p := path(u, v)) and e in [x for _, x in p]) for e, _, _, w in edges}
    assert {r.edge_id: r.weight for r in C.add_on_paths(s.forest, s.graph.edges, ops).collect()} == plus


def test_log_with_large_ids_late_places_and_stale_removals(spark):
    """Ids over 2^40, places over 2^23, a removal before the link, a second link by an id, removals of vertices not there yet."""
    from graphloom.schema import OP_LOG

    a, b, c, t = 2**40, 2**41 + 1, 3 * 10**12, 2**24
    ops = [(1, "remove_edge", 7, None, None), (2, "remove_vertex", None, c, None), (t, "link", 7, a, b), (t + 1, "link", 8, b, c), (t + 2, "link", 7, a, c), (t + 3, "link", 9, a, c), (t + 4, "remove_edge", 8, None, None), (t + 5, "remove_edge", 8, None, None), (t + 6, "remove_edge", 9, None, None), (t + 7, "remove_vertex", None, b, None), (t + 8, "link", 10, a, b), (t + 9, "remove_vertex", None, b, None)]
    log = spark.createDataFrame([(s, o, e, u, v, None, None) for s, o, e, u, v in ops], OP_LOG)
    assert {(r.edge_id, r.born, r.dies) for r in L.edge_lives(log).collect()} == {(7, t, t + 7), (8, t + 1, t + 4), (9, t + 3, t + 6)}
    assert {r.seq: r.was_bridge for r in L.removed_bridges(log).collect()} == {t + 4: False, t + 6: True}
    assert [tuple(r) for r in L.removed_vertices(log).collect()] == [(t + 7, b, [a])]
    q = spark.createDataFrame([(1, t, a, b), (2, t, a, c), (3, t + 1, a, c), (4, t + 6, a, b), (5, t + 8, a, b), (6, 5, a, a), (7, t + 9, a, a)], "qid long, t long, u long, v long")
    assert {r.qid: r.connected for r in L.as_of_connected(log, q).collect()} == {1: True, 2: False, 3: True, 4: True, 5: False, 6: False, 7: True}


def test_log_against_every_state(spark):
    """A random log asked at each place, divided in two, against the state built anew."""
    from graphloom.schema import OP_LOG

    rng = random.Random(23)
    ops = []
    for s in range(40):
        kind = rng.choice(["link"] * 5 + ["remove_edge"] * 2 + ["remove_vertex"])
        ops.append((s, kind, rng.randrange(s + 1) if kind == "remove_edge" else s, rng.randrange(9), rng.randrange(9)))
    log = spark.createDataFrame([(s, o, e, u, v, None, None) for s, o, e, u, v in ops], OP_LOG)
    points = spark.range(40).select(F.col("id").alias("t")).crossJoin(spark.range(9).withColumnRenamed("id", "vertex_id"))
    got = {(r.t, r.vertex_id): r.component_id for r in L.components_at(log, points, parts=2).collect()}
    seen, gone, live = set(), set(), {}
    for s, o, e, u, v in ops:
        if o == "link":
            if u != v and not {u, v} & gone:
                live[e] = (u, v)
            seen |= {u, v}
        elif o == "remove_edge":
            live.pop(e, None)
        elif u in seen and u not in gone:
            gone.add(u)
            live = {k: x for k, x in live.items() if u not in x}
        comp = list(range(9))
        for _ in range(9):
            for x, y in live.values():
                comp[x] = comp[y] = min(comp[x], comp[y])
        for x in range(9):
            assert got[(s, x)] == (comp[x] if x in seen - gone else None), (s, x)


def test_a_stream_goes_on_after_a_restart_and_a_batch_may_run_again(spark, tmp_path):
    from graphloom.schema import OP_LOG
    from graphloom.streaming.maintain import Maintainer

    rows = lambda *ops: spark.createDataFrame([(s, o, e, u, v, None, None) for s, o, e, u, v in ops], OP_LOG)
    state = lambda m: {r.vertex_id: r.component_id for r in m.components().collect()}
    at = str(tmp_path / "state")
    Maintainer(spark, at).apply(rows((1, "link", 1, 1, 2)), 0)
    assert state(Maintainer(spark, at)) == {1: 1, 2: 1}
    batch = rows((2, "link", 2, 5, 6), (3, "link", 3, 2, 5))
    for _ in range(2):
        m = Maintainer(spark, at)
        m.apply(batch, 1)
        assert state(m) == {1: 1, 2: 1, 5: 1, 6: 1} and m.done == 1
    m.apply(rows((4, "remove_edge", 3, None, None)), 2)
    assert state(Maintainer(spark, at)) == {1: 1, 2: 1, 5: 5, 6: 5} and m.versions() == [1, 2]


def test_no_lookup_finds_a_removed_id(spark):
    """Ids are never used again: a removed edge has no ends, a new one an id of its own."""
    g = make(spark, 4, ["01", "12"])
    g2 = g.remove_edges(spark.createDataFrame([(0,)], "edge_id long")).link(spark.createDataFrame([(7, 0, 1, 1, 7), (8, 0, 9, 1, 8), (9, 2, 2, 1, 9)], "edge_id long, u long, v long, weight long, seq long"))
    ends = g2.endpoints(spark.createDataFrame([(0,), (1,), (7,), (8,), (9,)], "edge_id long"))
    assert {(r.edge_id, r.u, r.v) for r in ends.collect()} == {(0, None, None), (1, 1, 2), (7, 0, 1), (8, None, None), (9, None, None)}


def test_find_edges_takes_a_tree_edge_then_the_smallest_level_and_id(spark):
    g = make(spark, 3, ["01", "01", "01", "12"])
    cover = spark.createDataFrame([(0, False, 3), (1, False, 1), (2, False, 1), (3, True, 0)], "edge_id long, is_tree boolean, level int")
    pairs = spark.createDataFrame([(1, 0), (2, 1), (0, 2)], "u long, v long")
    assert {(r.u, r.v): r.edge_id for r in g.find_edges(pairs, cover).collect()} == {(1, 0): 1, (2, 1): 3, (0, 2): None}


def test_fold_per_component(spark):
    import pyarrow as pa
    from graphloom.functions.aggregates import fold_per_component

    s = derive(make(spark, 5, ["01", "12", "34"]))
    f = lambda t: pa.table({"component_id": t["component_id"][:1], "edges": pa.array([",".join(map(str, sorted(t["edge_id"].to_pylist())))])})
    assert {tuple(r) for r in fold_per_component(s.comp, s.graph.edges, f, "component_id long, edges string").collect()} == {(0, "0,1"), (3, "2")}
    with pytest.raises(ValueError):
        fold_per_component(s.comp, s.graph.edges, f, "component_id long, edges string", most_edges=1)


@pytest.mark.parametrize("most", [3, 10**6])
def test_parts_of_a_few_edges_give_the_same_tables(spark, most, monkeypatch):
    """Tasks take three edges at a time, so components, forests and blocks meet in what they leave."""
    from graphloom.operators import structure as S

    monkeypatch.setattr(components, "CHUNK", 3)
    monkeypatch.setattr(S, "SMALL", 2)
    rng = random.Random(29)
    n = 40
    edges = [(i, *rng.sample(range(n - 2), 2)) for i in range(34)]
    g = Graph.of_edges(spark.createDataFrame(edges, "edge_id long, u long, v long"), spark.range(n).withColumnRenamed("id", "vertex_id"))
    s = derive(g, most_edges=most)
    comp, bridges, tree, block = brute(n, edges)
    assert {r.vertex_id: r.component_id for r in s.comp.collect()} == dict(enumerate(comp))
    assert {r.edge_id for r in s.bridges().collect()} == bridges and {r.edge_id for r in s.tree.collect()} == tree
    assert {r.vertex_id: r.block for r in s.blocks.collect()} == dict(enumerate(block))
    if most > 3:
        up = {r.vertex_id: r for r in s.forest.collect()}
        assert {r.parent_edge for r in up.values()} - {None} == tree and all(r.parent is None or up[r.parent].depth == r.depth - 1 and up[r.parent].tin < r.tin <= r.tout <= up[r.parent].tout for r in up.values())
        pairs = spark.createDataFrame([(q, rng.randrange(n), rng.randrange(n + 3)) for q in range(40)], "qid long, u long, v long")
        rows = lambda df: {(r.qid, r.cover_level, r.bridge) for r in df.collect()}
        assert rows(P.bridge_between(s, pairs)) == rows(P.between(s.forest, pairs, s.cover))
        assert s.cover_level().collect() and {(r.vertex_id, r.edge_id) for r in s.incident_non_tree().collect()} == {(x, e) for e, *ends in edges if e not in tree for x in ends}


def test_edges_need_no_structure_and_numbers_no_window(spark):
    """Scans of a graph derive nothing, and a number comes from a place in a part: no task holds a window."""
    from graphloom.plans import queries as Q
    from graphloom.sources import graphs

    sf = "/root/testdata/sf0.001"
    graphs.forget()
    for name in ("edges", "degree", "parallel_pairs", "edges_endpoints"):
        df = Q.QUERIES[name](spark, sf)
        assert "Window" not in df._jdf.queryExecution().toString()
    assert not {"comp", "tree", "_cut", "rooted"} & set(graphs.structure(spark, sf, "part_supplier").__dict__)
    assert Q.QUERIES["tree_edge_count"](spark, sf).first()[0] > 0 and "tree" not in graphs.structure(spark, sf, "customer_part").__dict__


def test_first_labels_without_a_row_for_each_pair(spark, monkeypatch):
    """The pass over a component gives what comparing all pairs gives, and writes out neither paths nor pairs."""
    rng = random.Random(31)
    n = 30
    edges = [(100 + i, i, rng.randrange(max(0, i - 4), i), 1) for i in range(1, n) if i != 17]
    s = derive(Graph.of_edges(spark.createDataFrame(edges, "edge_id long, u long, v long, weight long")))
    cover = s.graph.edges.withColumn("cover_level", (F.xxhash64("edge_id") % 3).cast("int"))
    labels = spark.createDataFrame([(i, rng.randrange(n), i % 3, 1) for i in range(14)], "label_id long, vertex_id long, level int, weight long")
    asked = spark.createDataFrame([(q, rng.randrange(n), rng.randrange(n + 1), q % 3) for q in range(60)], "qid long, u long, v long, level int")
    rows = lambda df: sorted((r.qid, r.label_id) for r in df.collect())
    want = rows(P._first_label_by_pairs(asked, s.rooted, cover, labels))
    assert rows(P.find_first_label(asked, s.rooted, cover, labels, most_vertices=0)) == want
    monkeypatch.setattr(P, "path_edges", None)
    assert rows(P.find_first_label(asked, s.rooted, cover, labels)) == want and len({x for _, x in want}) > 4


def test_graph_tables_are_broadcast_by_their_size_in_memory(spark):
    """A scratch table of 400,000 rows in a small file is no broadcast in a query over graphs, and other queries keep the session as it was."""
    from graphloom.sources import session
    from graphloom.sources.scratch import materialize

    t = materialize(spark.range(400_000).select(F.col("id").alias("vertex_id"), (F.col("id") % 25).alias("anc")), "wide")
    read = lambda: spark.read.schema(t.schema).parquet(t._scratch[0])
    plan = lambda: spark.range(10).join(read(), F.col("id") == F.col("vertex_id"))._jdf.queryExecution().optimizedPlan().children().apply(1).stats().sizeInBytes()
    small = int(str(plan()))
    session.bound_tasks(spark, 10**9)
    assert int(str(plan())) > 5 * small and int(spark.conf.get(session.FIRST)) == 125
    session.prepare(spark)
    assert int(str(plan())) == small and spark.conf.get(session.FIRST, None) is None
